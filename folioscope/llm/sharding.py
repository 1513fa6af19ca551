"""Two-pass external shuffle of records into shards of equal row counts.

Pass one scatters records over buckets that fit in a task's memory, by a seeded hash of the whole
record. Pass two takes each bucket as one array, puts it into Fisher-Yates order (Spark's
``shuffle``) and writes it. Laid end to end the buckets are one permutation of the table, which is
cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import kept

BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 20


def bucket_count(total_bytes: int, rows: int, bucket_bytes: int, most_buckets: int = MOST_BUCKETS) -> int:
    """Buckets that hold about ``bucket_bytes`` each (64 bytes are added per row)."""
    return min(max(math.ceil((total_bytes + 64 * rows) / bucket_bytes), 1), most_buckets)


def shuffle_into_shards(
    df: DataFrame, shards: int = 16, *, text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Every record once, with its ``shard`` (0 to shards-1) and its ``slot`` there (gapless from 0).

    * Law ``rows``: the row counts of any two shards differ by at most one.
    * Buckets come from a hash over all columns, so no value of one column (a hot source, one
      repeated text) makes a bucket large. Records equal in every column share a bucket; a table
      whose rows have an id has none.
    * A bucket's order is drawn in the task that writes it and read back from the written table: if
      an executor is lost, a bucket is drawn again as a whole, and no row is lost or doubled.
    * The offsets of the buckets are broadcast: one row per bucket, at most ``MOST_BUCKETS``.
    * Null columns are hashed and kept as null; an empty table gives no rows; columns named like the
      new ones are replaced; a record larger than a bucket is a bucket's only large one.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text)).cast("long")).alias("b")).first()
    buckets = bucket_count(found.b or 0, found.n, bucket_bytes)
    record = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in names])
    scattered = df.select(F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"), F.struct(key.alias("key"), record.alias("r")).alias("x"))
    whole = scattered.repartition(buckets, "bucket").groupBy("bucket").agg(F.collect_list("x").alias("xs"))
    # sorted first: the permutation then does not hang on the order in which blocks arrive
    drawn = whole.select("bucket", F.posexplode(F.shuffle(F.sort_array("xs"), F.lit(seed))).alias("pos", "x"))
    written = kept(drawn.select("bucket", "pos", "x.r"), "shards")
    sizes = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("before"))
    place = (F.col("before") + F.col("pos")).alias("place")
    placed = written.join(F.broadcast(offsets), "bucket").select("r", place)
    rows = max(found.n, 1)
    shard = F.expr(f"place * {shards}L div {rows}L")
    start = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("place") - start)
        .select(*[F.col("r")[f"c{i}"].alias(c) for i, c in enumerate(names)], F.col("shard").cast("int").alias("shard"), "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
