"""Incremental ingest of a document stream into a corpus without repeats, by keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.corpus import text_key

#: Seen digests lie in a store on disk, of which only changes are checkpointed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
KEY, ORIGIN = "_text_key", "_origin"
#: Rows that a task holds before it looks for repeats among them.
MOST_HELD = 50_000


def start_corpus(existing: DataFrame, corpus_path: str) -> None:
    """Write the rows a corpus starts from (possibly none); the first ingest takes them in."""
    existing.write.mode("overwrite").parquet(f"{corpus_path}/start")


def first_of_key(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row by ``order`` of each key, among the rows of a task; works on streams, where a sort does not."""
    sorting = [(KEY, "ascending"), *((c, "ascending") for c in order)]

    def reduced(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table, sorting, null_placement="at_start"))
        if not table.num_rows:
            return []
        keys = table.column(KEY)
        new = pc.not_equal(keys[1:], keys[:-1])
        return table.filter(pa.chunked_array([[True], *new.chunks], pa.bool_())).to_batches()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = limit = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > max(MOST_HELD, 2 * limit):
                held = reduced(held)
                size = limit = sum(b.num_rows for b in held)
        if held:
            yield from reduced(held)

    return rows.mapInArrow(first, rows.schema)


def ingest_stream(
    stream: DataFrame,
    corpus_path: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    position: str = "doc_id",
) -> StreamingQuery:
    """Append the stream's new texts to the corpus and stop when the source is read.

    Rows are cleaned by ``prepare`` (a row at a time). Of rows with one text the corpus keeps the first: those it started from go before
    all others, then earlier loads, then the least ``position``. Within a load repeats are dropped in the tasks that read them and
    again behind the shuffle, so a text that makes up most of a load is never moved whole.

    Which texts came in earlier loads is told by keyed state, a digest a text, that is checkpointed with the
    stream: a load looks its own digests up and nothing of the corpus is read again. A run that was lost goes on
    from the last checkpoint and leaves the same rows. Null texts count as one text; an empty stream adds nothing.
    """
    spark = stream.sparkSession
    rows = prepare(stream) if prepare else stream
    start = spark.read.parquet(f"{corpus_path}/start")
    seeds = spark.readStream.schema(start.schema).parquet(f"{corpus_path}/start")  # all files at once, with the first load
    both = seeds.withColumn(ORIGIN, F.lit(0)).unionByName(rows.withColumn(ORIGIN, F.lit(1)), allowMissingColumns=True)
    order = [ORIGIN, position]
    keyed = first_of_key(both.withColumn(KEY, text_key(F.col("text"))), order)
    once = first_of_key(keyed.repartition(KEY), order)
    fresh = once.dropDuplicates([KEY]).drop(KEY, ORIGIN)
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings it was started with
        return (
            fresh.writeStream.format("parquet")
            .option("path", f"{corpus_path}/rows")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_corpus(spark: SparkSession, corpus_path: str) -> DataFrame:
    """The rows taken in so far; rows of a load that has not ended are not seen."""
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{corpus_path}/rows/_spark_metadata")
    if not log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        return spark.read.parquet(f"{corpus_path}/start").limit(0)
    return spark.read.parquet(f"{corpus_path}/rows")
