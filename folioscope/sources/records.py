"""Records of quoted CSV files and JSON arrays, cut out of files of any size by many tasks.

A record may hold line breaks inside quotes, so a task that starts in the middle of a file cannot tell by itself where
records end. Files are read as atoms, the text up to a separator (a line break, or a closing brace), which Spark deals out
by byte ranges. A first pass sums up what each range does to the reader's state, quotes and depth, for either state it may
begin in; running over the ranges of a file gives the state in which each begins. A second pass cuts every range at its true
record ends. What a range's ends leave over, two pieces at most, is put together by file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import kept


class Format(NamedTuple):
    """How atoms change the state: ``effects`` gives, per atom, whether it flips quotes, and the change of depth if it begins
    outside and inside of quotes. A record ends after an atom that leaves the reader outside of quotes at the base depth."""

    separator: str
    effects: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]
    nested: bool


def csv_effects(atoms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A doubled quote flips twice, so only the number of quotes counts."""
    flips = np.array([a.count('"') & 1 for a in atoms], bool)
    level = np.zeros(len(atoms), np.int64)
    return flips, level, level


_ESCAPE = re.compile(r"\\.", re.DOTALL)


def json_effects(atoms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flips = np.zeros(len(atoms), bool)
    depths = np.zeros((2, len(atoms)), np.int64)
    for k, atom in enumerate(atoms):
        parts = (_ESCAPE.sub("", atom) if "\\" in atom else atom).split('"')
        flips[k] = len(parts) & 1 == 0
        for inside in (0, 1):
            out = "".join(parts[inside::2])
            # the brace that ended the atom closes a level if it stands outside of quotes
            depths[inside, k] = out.count("{") + out.count("[") - out.count("]") - (bool(flips[k]) == bool(inside))
    return flips, depths[0], depths[1]


CSV = Format("\n", csv_effects, False)
JSON = Format("}", json_effects, True)


def atoms(spark: SparkSession, path: str, kind: Format) -> DataFrame:
    """``file, start, value``: atoms in the order of each byte range, which begins at ``start``."""
    rows = spark.read.option("lineSep", kind.separator).text(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Slices of the batches that lie in one byte range."""
    for batch in batches:
        if batch.num_rows:
            file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
            cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield (int(file[a]), int(start[a])), batch.slice(a, b - a)


def begin_states(found: DataFrame, kind: Format) -> DataFrame:
    """``file, start, inside, depth, base``: the state in which every byte range begins, one row each."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for at, part in ranges(batches):
            values = part.column("value").to_pylist()
            flips, outside, inside = kind.effects(values)
            own = total.setdefault(at, [False, 0, 0, (values[0].lstrip("﻿ \t\r\n") or " ")[0]])
            turned = np.logical_xor.accumulate(np.concatenate([[own[0]], flips]))
            own[1] += int(np.where(turned[:-1], inside, outside).sum())
            own[2] += int(np.where(turned[:-1], outside, inside).sum())
            own[0] = bool(turned[-1])
        columns = list(zip(*((*k, *v) for k, v in total.items()))) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "start", "flips", "outside", "inside", "first"])

    summed = kept(found.mapInArrow(sums, "file long, start long, flips boolean, outside long, inside long, first string"), "ranges")
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)  # a row per byte range
    inside = F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1
    placed = summed.select("file", "start", inside.alias("begins_inside"), "outside", "inside", "first")
    change = F.when(F.col("begins_inside"), F.col("inside")).otherwise(F.col("outside"))
    depth = F.coalesce(F.sum("change").over(before), F.lit(0))
    whole = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = F.when(F.first("first").over(whole) == "[", 1).otherwise(0) if kind.nested else F.lit(0)
    placed = placed.withColumn("change", change)
    return placed.select("file", "start", F.col("begins_inside").alias("inside"), depth.cast("long").alias("depth"), base.cast("long").alias("base"))


#: What part of a record a row is: all of it, its begin, its end, or a middle.
WHOLE, BEGIN, END, MIDDLE = range(4)


def cut(found: DataFrame, states: DataFrame, kind: Format) -> DataFrame:
    """``file, start, number, part, value``: the records of each byte range, and the pieces at its ends."""
    sep = kind.separator
    close = sep if kind.nested else ""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, open_, begun, number, rows = None, None, [], False, 0, []

        def put(part: int, value: str) -> None:
            rows.append((*at, number, part, value))

        def end() -> None:
            """What is open at a byte range's end."""
            if open_:
                put(MIDDLE if begun and number == 0 else BEGIN, sep.join(open_) + sep)

        def emitted() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "start", "number", "part", "value"])
            rows.clear()
            return out

        for here, part in ranges(batches):
            values = part.column("value").to_pylist()
            if here != at:
                end()
                inside, depth, base = (part.column(c)[0].as_py() for c in ("inside", "depth", "base"))
                at, state, open_, number = here, (inside, depth), [], 0
                begun = here[1] > 0 and (inside or depth != base)
            flips, outside, within = kind.effects(values)
            turned = np.logical_xor.accumulate(np.concatenate([[state[0]], flips]))
            depths = state[1] + np.cumsum(np.where(turned[:-1], within, outside))
            state = (bool(turned[-1]), int(depths[-1]))
            last = 0
            for k in np.flatnonzero(~turned[1:] & (depths == base)).tolist():
                put(END if begun and number == 0 else WHOLE, sep.join([*open_, *values[last : k + 1]]) + close)
                open_, last, number = [], k + 1, number + 1
            open_ += values[last:]
            if rows:
                yield emitted()
        if at is not None:
            end()
        if rows:
            yield emitted()

    # a row per byte range, some millionths of the input; the atoms stay where they are, in their order
    rows = found.join(F.broadcast(states), ["file", "start"])
    return rows.select("file", "start", "value", "inside", "depth", "base").mapInArrow(records, "file long, start long, number long, part int, value string")


def read_records(spark: SparkSession, path: str, kind: Format) -> DataFrame:
    """``value, first``: the text of every record, and whether it is its file's first; blank ones are left out."""
    found = atoms(spark, path, kind)
    pieces = cut(found, kept(begin_states(found, kind), "states"), kind)
    whole = pieces.filter(F.col("part") == WHOLE).select("value", ((F.col("start") == 0) & (F.col("number") == 0)).alias("first"))
    # a begin and what follows up to its end make one record; a file has two pieces a byte range at most
    open_ = W.partitionBy("file").orderBy("start", "number")
    ends = pieces.filter(F.col("part") != WHOLE).withColumn("record", F.sum((F.col("part") == BEGIN).cast("int")).over(open_))
    in_order = F.sort_array(F.collect_list(F.struct("start", "number", "value")))
    joined = ends.groupBy("file", "record").agg(in_order.alias("pieces"))
    head = (F.col("pieces")[0]["start"] == 0) & (F.col("pieces")[0]["number"] == 0)
    rows = whole.unionByName(joined.select(F.array_join("pieces.value", "").alias("value"), head.alias("first")))
    if kind.nested:
        value = F.regexp_replace("value", r"^[﻿\s,\[]+", "")
        return rows.select(value.alias("value"), "first").filter(F.startswith("value", F.lit("{")))
    value = F.regexp_replace("value", r"[\r\n]+\z", "")
    return rows.select(value.alias("value"), "first").filter("value != ''")
