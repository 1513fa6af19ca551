"""Near-duplicate documents by word shingles: fast similarity sketches, bands, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.linking import PART, band_column, linked_components
from folioscope.llm.shingles import set_digest, shingle_set, text_words
from folioscope.llm.sketches import tuned_bands
from folioscope.llm.workers import tidy
from folioscope.session import kept

PERCENT = 85
MISS = 1e-5
COORDINATES = 224


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, n, digest, bands`` of every row of ``docs`` (``doc_id, text``)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                sets = [shingle_set(w) for w in text_words(part.column("text").to_pylist())]
                columns = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, band_column(sets, bands, rows)], ["doc_id", "n", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(sign), "doc_id long, n long, digest binary, bands array<long>")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, miss: float = MISS, coordinates: int = COORDINATES) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if 100 * intersection >= ``percent`` * union holds for their sets of five-word
    shingles (A-Z in lower case; fewer words are one shingle). ``component_id`` is the least doc_id that can be
    reached, itself included; ``kept`` marks that document. A pair of just that similarity is missed by the bands
    with probability ``miss`` at most.

    Texts that are null, empty or without words have an empty set and are linked with nothing. Equal rows
    get equal results; a doc_id that comes with several texts gets the component of each, and a link of one of
    them may hold for the others. A row without doc_id is linked with nothing, has
    no component and is kept. Very long texts are hashed in slices; other columns are ignored; an empty table
    gives no rows. Equal sets are put together first, so copies cost one row each.
    """
    bands, rows = tuned_bands(percent / 100, miss, coordinates)
    signed = kept(signatures(docs, bands, rows), "signatures")
    classes = kept(signed.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    nodes = signed.withColumnRenamed("doc_id", "id").join(classes.select("id").distinct(), "id", "left_semi").select("id", "bands")

    def fetch(ids: DataFrame) -> DataFrame:  # a merge join moves the texts in the same way at every size
        return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id")

    found = linked_components(kept(nodes, "nodes"), fetch, percent)
    labels = classes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n", "digest").join(labels, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
