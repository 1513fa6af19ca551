"""Passages that stand word for word at an earlier place, wherever their lines end.

A window is ``RUN`` words in a row. It is removed if the same words stand at an earlier place (least doc_id, then place)
that it does not overlap. Windows are found without a row for each of them: every window picks the least of the hashes of
its ``GRAM``-word grams (winnowing), so equal windows pick equal grams, and the windows in a row that pick one gram are a
segment. Only segments whose gram occurs again go on. Equal segments have equal windows, so of each segment the first
stands for all; where a gram has several segments, the windows of the first of each are compared one by one. Nothing is
left to chance but the equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shingles import _BLANK, _powers_to, mixed, word_hashes
from folioscope.llm.workers import tidy
from folioscope.session import discard, kept

RUN = 50
GRAM = 15
#: Bytes of short texts worked on together, and windows worked on at a time.
GROUP_BYTES, WINDOWS = 1 << 20, 1 << 20
#: Parts that the rows of one key are dealt to.
SLICES = 32
PLACE = "doc_id", "line", "start", "text_hash"


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` words in a row, from prefix sums modulo 2**64."""
    up, back = _powers_to(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * back[: len(words) - n + 1])


def picks(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least hash of every ``width`` in a row."""
    at, reach = np.arange(len(hashes)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = at[:-step], at[step:]
        at = np.where(hashes[b] < hashes[a], b, a)
        reach += step
    return at


def spans(words: np.ndarray, owner: np.ndarray, run: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(first window, last window, gram hash, segment hash, window hashes, offset)`` of the segments, slice by slice; ``owner``
    is the text of each word."""
    for offset in range(0, len(words) - run + 1, WINDOWS):
        own = words[offset : offset + WINDOWS + run - 1]
        text = owner[offset : offset + len(own)]
        gram, window = grams(own, GRAM), grams(own, run)
        pick = picks(gram, run - GRAM + 1)
        whole = text[: len(window)] == text[run - 1 :]
        change = np.ones(len(window), bool)
        change[1:] = (pick[1:] != pick[:-1]) | (whole[1:] != whole[:-1]) | (text[1 : len(window)] != text[: len(window) - 1])
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(window)) - 1
        there = whole[first]
        first, last = first[there], last[there]
        # a segment is told by its first and last window and their distance: they overlap and cover it
        segment = mixed(window[first] ^ mixed(window[last] + (last - first + 1).astype(np.uint64)))
        yield first + offset, last + offset, gram[pick[first]], segment, window, offset


class Words:
    """The words of some texts in one row: ``words``, ``owner``, and their places in characters and lines."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(parts)
        self.words, starts = word_hashes(data)
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(np.diff(~_BLANK[raw], prepend=False, append=False))[1::2]
        begin = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
        self.owner = np.searchsorted(begin, starts, "right") - 1
        breaks = np.flatnonzero(raw == 10)
        base = begin[self.owner]
        self.line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, base)
        if len(raw) and raw.max() > 127:
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            starts, ends, base = chars[starts], chars[ends], chars[base]
        self.start, self.end = starts - base, ends - base


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batches of about ``GROUP_BYTES`` of text each, or of one text, with their words."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        a = size = 0
        for b, text in enumerate(texts):
            if b > a and size + len(text) > GROUP_BYTES:
                yield batch.slice(a, b - a), Words(texts[a:b])
                a, size = b, 0
            size += len(text)
        if a < len(texts):
            yield batch.slice(a), Words(texts[a:])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


SEGMENT = "gram long, segment long, doc_id long, line int, start long, text_hash int, length int"
WINDOW = "window long, doc_id long, line int, start long, text_hash int, length int"


def segments(docs: DataFrame, run: int) -> DataFrame:
    """The segments of ``docs`` (``doc_id, text_hash, text``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in grouped(batches):
            for first, last, gram, segment, *_ in spans(w.words, w.owner, run):
                owner = pa.array(w.owner[first])
                length = (w.end[last + run - 1] - w.start[first]).astype(np.int32)
                columns = [signed(gram), signed(segment), part.column("doc_id").take(owner), pa.array(w.line[first].astype(np.int32)), pa.array(w.start[first].astype(np.int64)), part.column("text_hash").take(owner), pa.array(length)]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "segment", *PLACE, "length"])

    return docs.mapInArrow(tidy(cut), SEGMENT)


def windows(docs: DataFrame, wanted: DataFrame, run: int) -> DataFrame:
    """The windows of the segments ``wanted`` (``doc_id, text_hash, start``)."""
    by_doc = wanted.groupBy("doc_id", "text_hash").agg(F.collect_set("start").alias("wanted"))  # a document's segments

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in grouped(batches):
            asked = [np.array(x, np.int64) for x in part.column("wanted").to_pylist()]
            asked = np.sort(np.concatenate([x * len(asked) + k for k, x in enumerate(asked)]))
            for first, last, _, _, window, offset in spans(w.words, w.owner, run):
                take = np.isin(w.start[first].astype(np.int64) * part.num_rows + w.owner[first], asked)
                first, sizes = first[take], (last - first + 1)[take]
                at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                owner = pa.array(w.owner[at])
                length = (w.end[at + run - 1] - w.start[at]).astype(np.int32)
                columns = [signed(window[at - offset]), part.column("doc_id").take(owner), pa.array(w.line[at].astype(np.int32)), pa.array(w.start[at].astype(np.int64)), part.column("text_hash").take(owner), pa.array(length)]
                yield pa.RecordBatch.from_arrays(columns, ["window", *PLACE, "length"])

    rows = docs.join(by_doc.hint("merge"), ["doc_id", "text_hash"])
    return rows.select("doc_id", "text_hash", "text", "wanted").mapInArrow(tidy(cut), WINDOW)


def firsts(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the first place of their ``keys``.

    The rows of a key are dealt to ``SLICES`` slices by their document. The first places of the slices give that of the key, which goes
    back to every slice there is: a key that most rows share is spread over as many tasks, and one with few rows costs few.
    """
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SLICES)).cast("int"))
    place = F.struct(*PLACE, "length")
    of_slice = dealt.groupBy(*keys, "slice").agg(F.min(place).alias("first"))
    of_key = of_slice.groupBy(*keys).agg(F.min("first").alias("first"), F.collect_set("slice").alias("slices"))  # at most SLICES numbers
    back = of_key.select(*keys, "first", F.explode("slices").alias("slice"))
    return dealt.join(back, [*keys, "slice"]).drop("slice")


def same_place() -> F.Column:
    return (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("start") == F.col("first.start"))


def overlapping() -> F.Column:
    """In the first one's text and over its end."""
    return (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("start") < F.col("first.start") + F.col("first.length"))


def repeated_windows(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id, text_hash, line, start, length, kept_doc_id, kept_line``: spans that cover the removed windows, overlapping.

    ``docs`` has ``doc_id, text_hash, text`` without nulls; rows equal in all are one place.
    """
    found = kept(segments(docs, run), "segments")
    several = kept(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "several_grams")
    again = kept(found.join(several, "gram", "left_semi"), "again")
    discard(found, several)
    placed = kept(firsts(again, "gram", "segment"), "placed")
    discard(again)
    whole = placed.filter(~overlapping())
    # what stands for its segment where a gram has several, and segments that overlap their first
    mixed_grams = placed.groupBy("gram").agg(F.min("segment").alias("lo"), F.max("segment").alias("hi")).filter("lo != hi").select("gram")
    heads = placed.filter(same_place()).join(mixed_grams, "gram", "left_semi").select("doc_id", "text_hash", "start")
    looped = placed.filter(overlapping() & ~same_place())
    heads = heads.unionByName(looped.select("doc_id", "text_hash", "start")).unionByName(looped.select("first.doc_id", "first.text_hash", "first.start"))
    one_by_one = kept(windows(docs, heads, run), "windows")
    out = [x.select("doc_id", "text_hash", "line", "start", "length", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.line").alias("kept_line")) for x in (whole, firsts(one_by_one, "window").filter(~overlapping()))]
    out = kept(out[0].unionByName(out[1]).distinct(), "spans")
    discard(placed, one_by_one)
    return out
