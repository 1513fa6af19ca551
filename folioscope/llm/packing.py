"""Documents packed into token sequences by length patterns.

The pieces' lengths are counted (one number per length, at most ``capacity`` of them). Patterns of one to three
lengths that fill a sequence are enumerated over length bins, their repeat counts are fitted to the counts by
non-negative least squares and rounded down to what is there, and the pieces left over go, longest
first, to the fullest sequence with room for them. The plan is made of ranges: ``n`` pieces of one length go to
``n`` consecutive sequences at one offset; its size hangs on the capacity, not on the number of pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.tokens import encoder, text_groups
from folioscope.llm.workers import tidy
from folioscope.session import kept

CAPACITY = 4096
BINS = 256
PIECE = "piece int, start long, length long, ids_crc32 long"
#: Most pieces of one length in a window's group.
GROUP_ROWS = 1_000_000
#: Bytes of short texts encoded together.
GROUP_BYTES = 4 << 20
SHIFT = 40  # a length's ranks are below 2 ** SHIFT


# --- the plan, on the driver ------------------------------------------------------------------


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 that makes ``a @ x`` close to ``b``: columns enter while they lower the error, and leave at zero."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-9 * max(np.abs(a.T @ b).max(initial=0.0), 1.0)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[inside] = -np.inf
        if inside.all() or gain.max() <= least:
            break
        inside[np.argmax(gain)] = True
        while inside.any():
            chosen = np.flatnonzero(inside)
            own = a[:, chosen]
            tried = np.linalg.solve(own.T @ own + 1e-10 * np.eye(len(chosen)), own.T @ b)
            if (tried > 0).all():
                x[:] = 0
                x[chosen] = tried
                break
            now, low = x[chosen], tried <= 0
            step = np.min(now[low] / np.maximum(now[low] - tried[low], 1e-300))
            x[chosen] = now + step * (tried - now)
            inside[chosen[(x[chosen] <= 1e-12) & low]] = False
            x[~inside] = 0
    return x


def length_patterns(units: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Multisets of one to three bins, each present, that sum to ``units``."""
    there = set(np.flatnonzero(present).tolist())
    found = [(units,)] if units in there else []
    for i in sorted(there):
        j = units - i
        if i >= j > 0 and j in there:
            found.append((i, j))
        for j in sorted(there):
            k = units - i - j
            if i >= j >= k > 0 and k in there:
                found.append((i, j, k))
    return found


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, bins: int = BINS) -> tuple[np.ndarray, int]:
    """``(plan, sequences)`` for ``counts`` pieces of each length from 1 to ``capacity``.

    A row of the plan is (length, first rank, first sequence, pieces per sequence, offset): the pieces of
    that length from that rank on go to the sequences from that number on. No counts give an empty plan.
    """
    left = {length: int(n) for length, n in counts.items() if n > 0}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    used: dict[int, int] = defaultdict(int)  # ranks given out, by length
    plan: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> ranges of sequences
    sequences = 0

    def put(length: int, first: int, n: int, each: int, room: int) -> None:
        plan.append((length, used[length], first, each, capacity - room))
        used[length] += n * each
        left[length] -= n * each

    # patterns over bins; a bin's lengths are at most bin * width, so a pattern never overflows
    width = -(-capacity // bins)
    units = capacity // width
    of_bin: dict[int, list[int]] = defaultdict(list)
    for length in sorted(left, reverse=True):
        if -(-length // width) <= units:
            of_bin[-(-length // width)].append(length)
    present = np.zeros(units + 1, bool)
    present[list(of_bin)] = True
    patterns = length_patterns(units, present)
    if patterns:
        a = np.zeros((units, len(patterns)))
        for k, pattern in enumerate(patterns):
            for i in pattern:
                a[i - 1, k] += 1
        b = np.array([sum(left[x] for x in of_bin.get(i + 1, [])) for i in range(units)], float)
        # short pieces left over are cheap to place, long ones are not
        weight = np.sqrt(np.arange(1, units + 1) / units)[:, None]
        repeats = non_negative_least_squares(a * weight, b * weight[:, 0], 3 * units)
        for k in np.argsort(-repeats, kind="stable"):
            pattern = patterns[k]
            room_for = min(sum(left[x] for x in of_bin[i]) // len(list(same)) for i, same in groupby(pattern))
            n = min(int(repeats[k] + 1e-6), room_for)
            if n <= 0:
                continue
            ranges = [(sequences, n, capacity)]
            sequences += n
            for i in pattern:
                filled = []
                for first, m, room in ranges:
                    while m:
                        length = next(x for x in of_bin[i] if left[x])
                        take = min(m, left[length])
                        put(length, first, take, 1, room)
                        filled.append((first, take, room - length))
                        first, m = first + take, m - take
                ranges = filled
            for first, m, room in ranges:
                open_[room].append((first, m))
    # what is left, longest first, each to the fullest sequence that has room
    rooms = sorted(r for r in open_ if r > 0)
    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect.bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // length
            if at < len(rooms):
                first, m = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                first, m = sequences, max(left[length] // each, 1)
                sequences += m
            n = min(m, left[length] // each)
            if n == 0:
                n, each = 1, left[length]
            put(length, first, n, each, room)
            for rest, start, many in ((room - each * length, first, n), (room, first + n, m - n)):
                if many and rest:
                    if not open_[rest]:
                        bisect.insort(rooms, rest)
                    open_[rest].append((start, many))
    return np.array(sorted(plan), np.int64).reshape(-1, 5), sequences


# --- on Spark ---------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Rows of ``(doc_id, piece, start, length, ids_crc32[, ids])``: a document's ids, then ``end_id``, cut where
    they are longer than ``capacity``. ``ids`` are little-endian unsigned 32-bit."""
    end = np.asarray([end_id], "<u4").tobytes()
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, {PIECE}" + ", ids binary" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for at, many in text_groups(batch.column(1), GROUP_BYTES):
                part = batch.slice(at, many)
                ids = part.column(0)
                rows: list[list] = [[], [], [], [], [], []]
                for row, data in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    data += end
                    for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[start : start + 4 * capacity]
                        for column, value in zip(rows, (row, piece, start // 4, len(own) // 4, zlib.crc32(own), own)):
                            column.append(value)
                made = [ids.take(pa.array(rows[0], pa.int64()))]
                made += [pa.array(r, k) for r, k in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(made[: len(names)], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(cut, "tokens"), schema)


def ranked(pieces: DataFrame, most: int) -> DataFrame:
    """``pieces`` with a ``rank`` from 0 among those of equal length, in any order.

    A length that very many pieces share is cut into slices by a hash of the piece; slices are numbered on
    their own and shifted by the sizes of the slices before them.
    """
    slices = max(most // GROUP_ROWS, 31) + 1
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).alias("slice")
    sliced = pieces.select("*", key)
    sizes = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("slice")) - F.col("n")  # a row per slice
    shifts = sizes.select("length", "slice", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = sliced.withColumn("inside", inside).join(shifts, ["length", "slice"])
    return numbered.withColumn("rank", (F.col("before") + F.col("inside")).cast("long")).drop("slice", "inside", "before")


def place(pieces: DataFrame, capacity: int = CAPACITY, bins: int = BINS) -> DataFrame:
    """``pieces`` (any columns, with ``doc_id, piece, ids_crc32, length``) with ``sequence_id`` and ``offset``.

    ``pieces`` is read three times: hand over a written table. The plan is broadcast; its size is bounded by ``capacity``.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    plan, _ = plan_sequences(counts, capacity, bins)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    rows = ranked(pieces, max(counts.values(), default=0))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        starts = (plan[:, 0] << SHIFT) + plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, (length << SHIFT) + rank, "right") - 1
            more = rank - plan[at, 1]
            each = plan[at, 3]
            columns = [batch.column(c) for c in names]
            columns += [pa.array(plan[at, 2] + more // each), pa.array(plan[at, 4] + more % each * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return rows.select(*names, "rank").mapInArrow(tidy(look_up), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document of ``docs`` (``doc_id, text``) as pieces placed in sequences of at most ``capacity`` ids.

    Null text is empty and gives a piece of one id; a null doc_id is kept; repeated rows are documents of their
    own; texts of any length are cut only where they pass the capacity; other columns are ignored; an empty
    table gives no rows.
    """
    pieces = kept(token_pieces(docs, tokenizer, end_id=end_id, capacity=capacity, with_ids=with_ids), "pieces")
    return place(pieces, capacity)
