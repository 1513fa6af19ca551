"""Repeated paragraphs across documents: MinHash bands, exact verification, removal of all but the first.

Two things are removed: lines that are like an earlier one, and passages of ``passages.RUN`` words or more that stand word
for word at an earlier place, whatever the lines (see ``passages``).

A paragraph is a line with at least ``MIN_WORDS`` words. Equal paragraphs are put together first; what differs is
sketched, banded so that few pairs at the threshold are missed, verified by exact Jaccard similarity of the full sets of
five-word shingles, and clustered by connected components. In each cluster the first paragraph (least doc_id, then
place) stays; the others are removals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import passages
from folioscope.llm.linking import PART, band_column, linked_components
from folioscope.llm.names import free
from folioscope.llm.shingles import shingle_sets, text_words
from folioscope.llm.sketches import tuned_bands
from folioscope.llm.workers import tidy
from folioscope.session import discard, kept

PERCENT = 80
MIN_WORDS = 25
#: Pairs of just the threshold's similarity are missed with this probability at most.
MISS = 2e-3
COORDINATES = 80


def lines_of(texts: list[str | None], min_words: int) -> tuple[list[int], list[int], list[int], list[str], list[np.ndarray]]:
    """``(row, line number, start, line, words)`` of the lines that are paragraphs; starts count characters."""
    rows, places, starts, lines = [], [], [], []
    for row, text in enumerate(texts):
        start = 0
        for place, line in enumerate((text or "").split("\n")):
            if len(line) >= 2 * min_words - 1:
                rows.append(row)
                places.append(place)
                starts.append(start)
                lines.append(line)
            start += len(line) + 1
    words = list(text_words(lines))
    enough = [i for i, w in enumerate(words) if len(w) >= min_words]
    return tuple([x[i] for i in enough] for x in (rows, places, starts, lines, words))


def paragraphs(docs: DataFrame, bands: int, rows: int, min_words: int) -> DataFrame:
    """``doc_id, text_hash, place, start, length, digest, bands`` of every paragraph of ``docs`` (``keyed``)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                owner, place, start, lines, words = lines_of(part.column("text").to_pylist(), min_words)
                for a in range(0, len(lines), 2 * PART):
                    b = min(a + 2 * PART, len(lines))
                    sets, digests = shingle_sets(words[a:b])
                    own = pa.array(owner[a:b], pa.int64())
                    columns = [part.column("doc_id").take(own), part.column("text_hash").take(own), pa.array(place[a:b], pa.int32()), pa.array(start[a:b], pa.int64())]
                    columns += [pa.array([len(x) for x in lines[a:b]], pa.int64()), pa.array(digests, pa.binary()), band_column(sets, bands, rows)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "place", "start", "length", "digest", "bands"])

    schema = "doc_id long, text_hash int, place int, start long, length long, digest binary, bands array<long>"
    return docs.mapInArrow(tidy(sign), schema)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text`` of the rows that have paragraphs; the hash tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("text_hash"), "text").filter("doc_id is not null and text is not null")


def paragraph_texts(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """``id, text`` of the paragraphs ``wanted`` (``id, doc_id, place, digest``)."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("id", "place", "digest")).alias("wanted"))  # a document's lines

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_at in range(0, batch.num_rows, PART):
                part = batch.slice(slice_at, PART)
                asked = [{(w["place"], w["digest"]): w["id"] for w in row} for row in part.column("wanted").to_pylist()]
                owner, place, _, lines, words = lines_of(part.column("text").to_pylist(), min_words)
                places = [{p for p, _ in row} for row in asked]
                at = [k for k, (o, p) in enumerate(zip(owner, place)) if p in places[o]]
                _, digests = shingle_sets([words[k] for k in at])
                found = [(asked[owner[k]].get((place[k], d)), lines[k]) for k, d in zip(at, digests)]
                found = [(i, t) for i, t in found if i is not None]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], ["id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(by_doc.hint("merge"), "doc_id")  # moved in the same way at every size
    return rows.select("text", "wanted").mapInArrow(tidy(extract), "id long, text string")


def outside(spans: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """What of ``spans`` lies outside of the removed ``lines``, as pieces that do not overlap; a piece beside a removed line with fewer
    than ``MIN_WORDS`` words is no paragraph and stays."""
    by_doc = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "length", "kept_doc_id", "kept_line")).alias("spans"))  # a document's
    gone = lines.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "length")).alias("gone"))

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for doc, text_hash, found, removed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "spans", "gone"))):
                holes = sorted((g["start"], g["start"] + g["length"]) for g in removed or [])
                at, k, last = 0, 0, None
                for start, end, *first in sorted((x["start"], x["start"] + x["length"], x["kept_doc_id"], x["kept_line"]) for x in found):
                    at = max(at, start)
                    while at < end:
                        while k < len(holes) and holes[k][1] <= at:
                            k += 1
                        if k < len(holes) and holes[k][0] <= at:
                            at = holes[k][1]
                            continue
                        stop = min(end, holes[k][0]) if k < len(holes) else end
                        if last and last[3] == at:
                            last[3] = stop  # goes on where the last piece ends
                        else:
                            last = [doc, text_hash, at, stop, *first]
                            pieces.append(last)
                        at = stop
            columns = list(zip(*pieces)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "text_hash", "start", "end", "kept_doc_id", "kept_paragraph"])

    schema = "doc_id long, text_hash int, start long, end long, kept_doc_id long, kept_paragraph int"
    pieces = by_doc.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "spans", "gone").mapInArrow(tidy(subtract), schema)
    by_doc = pieces.filter("end - start > 1 or start = 0").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end", "kept_doc_id", "kept_paragraph")).alias("pieces"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text_hash, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "pieces"))):
                line = at = 0
                for x in sorted(found, key=lambda x: x["start"]):
                    piece = text[x["start"] : x["end"]]
                    start = x["start"] + len(piece) - len(piece.lstrip())
                    line, at = line + text.count("\n", at, start), start
                    if len(next(text_words([piece]))) >= MIN_WORDS:
                        out.append((doc, text_hash, line, start, len(piece.strip()), x["kept_doc_id"], x["kept_paragraph"]))
            columns = list(zip(*out)) or [()] * 7
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "text_hash", *REMOVAL[1:]])

    rows = docs.join(by_doc.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    schema = "doc_id long, text_hash int, paragraph int, start long, length long, kept_doc_id long, kept_paragraph int"
    return rows.select("doc_id", "text_hash", "text", "pieces").mapInArrow(tidy(place), schema)


REMOVAL = ["doc_id", "paragraph", "start", "length", "kept_doc_id", "kept_paragraph"]


def repeated_paragraphs(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, miss: float = MISS, coordinates: int = COORDINATES, by_text: bool = False) -> DataFrame:
    """One row per removal: ``doc_id, paragraph, start, length, kept_doc_id, kept_paragraph``.

    ``paragraph`` is the line's number in its text, ``start`` and ``length`` its place in characters; the last two name the
    paragraph that stays for it. Paragraphs are alike if the Jaccard similarity of their sets of five-word shingles is
    ``percent`` / 100 or more, and belong together if a chain of such links joins them.

    With ``by_text`` a column ``text_hash`` tells the texts of one doc_id apart. Shorter lines, null and empty texts have no paragraphs; rows without doc_id are left alone. Rows that are equal in doc_id
    and text are told apart by nothing: their paragraphs are one place, of which nothing is removed by itself. Long
    texts are hashed line by line, and a line of any length is one paragraph; other columns are ignored; an empty table gives no rows.
    """
    bands, rows = tuned_bands(percent / 100, miss, coordinates)
    texts = keyed(docs)
    found = paragraphs(texts, bands, rows, min_words).withColumn("id", F.monotonically_increasing_id())
    found = kept(found, "paragraphs")  # ids are fixed from here on
    classes = kept(found.groupBy("digest").agg(F.min("id").alias("id")), "classes")
    firsts = classes.select("id")
    nodes = found.select("id", "bands").join(firsts, "id", "left_semi")

    def fetch(ids: DataFrame) -> DataFrame:
        return paragraph_texts(docs, found.select("id", "doc_id", "place", "digest").join(ids, "id"), min_words)

    labels = classes.join(linked_components(nodes, fetch, percent), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    placed = found.select("doc_id", "text_hash", "place", "start", "length", "digest").distinct().join(labels, "digest")
    # the first place of a cluster, in numbers only: the least doc_id, then the least place there
    docs_of = placed.groupBy("component").agg(F.min("doc_id").alias("kept_doc_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("component", "kept_doc_id")
    several = kept(placed.drop("digest").join(docs_of, "component"), "several")
    first = several.filter("doc_id = kept_doc_id").groupBy("component").agg(F.min("place").alias("kept_paragraph"))
    out = several.join(first, "component").filter("doc_id != kept_doc_id or place != kept_paragraph")
    out = out.select("doc_id", "text_hash", F.col("place").alias("paragraph"), "start", "length", "kept_doc_id", "kept_paragraph")
    lines = kept(out if by_text else out.select(*REMOVAL).distinct(), "lines")
    discard(found, classes, several)
    return lines


def repeats(docs: DataFrame, run: int = passages.RUN, by_text: bool = False) -> DataFrame:
    """The rows of ``repeated_paragraphs`` and, for passages, one row per piece that lies outside of the removed lines.

    Every ``run`` words in a row that stand at an earlier place (least doc_id, then place) and do not overlap it are
    removed, whatever the lines: ``paragraph`` is the line in which a piece begins, ``start`` and ``length`` its place in
    characters, and the place that stays is that of its first ``run`` words. Letters A-Z count as lower case, blanks as one.
    """
    lines, texts = repeated_paragraphs(docs, by_text=True), keyed(docs)
    out = lines.unionByName(outside(passages.repeated_windows(texts, run), lines, texts))
    return out if by_text else out.select(*REMOVAL).distinct()


def left_of(text: str | None, gone: list | None) -> str | None:
    """``text`` without the spans ``gone``; lines of which only blanks are left go with their line break."""
    if text is None or not gone:
        return text
    spans = sorted((g["start"], g["start"] + g["length"]) for g in gone)
    out, at, k = [], 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        rest, place, touched = [], at, False
        for start, stop in spans[k:]:
            if start >= end and (start > end or line):
                break
            if start < at == end < stop:
                touched = True  # an empty line inside a passage
            elif start < end:
                touched = True
                rest.append(text[place : max(place, start)])
                place = max(place, min(stop, end))
            if stop >= end:
                break
        left = "".join(rest) + text[place:end]
        if not touched or left.strip():
            out.append(left)
        at = end + 1
    return "\n".join(out)


def without_repeats(docs: DataFrame, removals: DataFrame) -> DataFrame:
    """``docs`` without the removed spans (``doc_id, start, length``, and ``text_hash`` if there), ``n_chars`` counted anew if
    there; texts left blank go.

    A line that goes as a whole takes one line break with it. Documents without removals are handed on as they are.
    """
    keys = [c for c in ("doc_id", "text_hash") if c in removals.columns]
    own = {c: free(docs.columns, f"_{c}") for c in (*keys, "gone")}
    gone = F.col(own["gone"])
    spans = removals.groupBy(*[F.col(k).alias(own[k]) for k in keys]).agg(F.collect_set(F.struct("start", "length")).alias(own["gone"]))  # a document's
    of_text = F.col(own["doc_id"]) == F.col("doc_id")
    rows = docs.join(kept(spans, "spans"), of_text & (F.col(own["text_hash"]) == F.hash("text")) if len(keys) > 1 else of_text, "left")
    left = F.udf(left_of, "string", useArrow=True)(F.when(gone.isNotNull(), F.col("text")), gone)
    rows = rows.withColumn("text", F.when(gone.isNull(), F.col("text")).otherwise(left)).filter(gone.isNull() | (F.trim("text") != ""))
    rows = rows.withColumn("n_chars", F.when(gone.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows
    return rows.select(*docs.columns)
