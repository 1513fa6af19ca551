"""Joins and positions that hold when one key owns a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.patterns import let_sql

BROADCAST_ROWS = 10_000
SALTS = 64
# Rows dealt anew by ``spread``: at least so many a task, and at most so many tasks a core.
ROWS_PER_TASK = 50_000
TASKS_PER_CORE = 4


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the tasks that read them would not share them evenly; other inputs are left alone.

    Pattern matching is heavy per row, and a file is split by bytes but read by row groups: a table in one or a few row
    groups is worked on by as many cores, however many splits it has. The rows per split come from the files' footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    rows, rounds = sum(sizes), math.ceil(len(sizes) / cores)
    if rounds * max(sizes, default=0) * cores <= 1.25 * rows:
        return df
    return df.repartition(cores * min(max(rows // (cores * ROWS_PER_TASK), 1), TASKS_PER_CORE), key)


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose values are worked out once, where they stand.

    A plain projection is repeated inside every filter on it, and such a filter sinks below
    shuffles; a generated row stays in place. For values that are costly per row.
    """
    made = F.inline(F.array(F.struct(*[c.alias(f"_new_{n}") for n, c in columns.items()])))
    rows = df.select(*[F.col(c) for c in df.columns], made)
    kept = [F.col(c) for c in df.columns if c not in columns]
    return rows.select(*kept, *[F.col(f"_new_{n}").alias(n) for n in columns])


def attach_class_table(
    df: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner"
) -> DataFrame:
    """Join ``df`` with a table of one row per class, without shuffling hot classes whole.

    The table is read up to ``BROADCAST_ROWS`` rows; if that is all of it, those rows are
    broadcast and ``df`` is not shuffled. A larger table is repeated per salt and joined on
    (class, salt), so a hot class spreads over ``SALTS`` tasks. Null classes match nothing.
    """
    rows = table.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) <= BROADCAST_ROWS:
        small = df.sparkSession.createDataFrame(rows, table.schema)
        return df.join(F.broadcast(small), on, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    keys = [on] if isinstance(on, str) else on
    return spread.join(salted, [*keys, "_salt"], how).drop("_salt")


def with_position(
    df: DataFrame, key: str, name: str = "pos", cuts: int = 64, rows_per_bucket: int = 1_000_000
) -> DataFrame:
    """Number the rows 1..n by a unique numeric ``key`` without sorting them in one task.

    Quantiles of the key cut the rows into like-sized ranges and each range into equal steps,
    as many as bring a bucket to about ``rows_per_bucket``. Rows are numbered inside their
    bucket and shifted by the sizes of the buckets before it. The shifts, one row per
    bucket, are what is broadcast.
    """
    shares = [i / cuts for i in range(cuts + 1)]
    found = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, shares).alias("q")).first()
    bounds = sorted({int(b) for b in found.q or [0]})
    steps = min(max(math.ceil(found.n / (cuts * rows_per_bucket)), 1), 4096)
    starts = ", ".join(f"{b}L" for b in bounds)
    widths = ", ".join(f"{max(b - a, 1)}L" for a, b in zip(bounds, [*bounds[1:], bounds[-1] + 1]))
    inside_range = (
        f"least(greatest((x.k - array({starts})[x.r]) * {steps} div array({widths})[x.r], 0), {steps - 1})"
    )
    key_and_range = let_sql(
        F.col(key).cast("bigint"),
        f"struct(t as k, greatest(size(filter(array({starts}), b -> t >= b)) - 1, 0) as r)",
    )
    bucketed = df.withColumn("_bucket", let_sql(key_and_range, f"x.r * {steps} + {inside_range}", "x"))
    sizes = bucketed.groupBy("_bucket").count()
    shifts = sizes.select(
        "_bucket", (F.sum("count").over(W.orderBy("_bucket")) - F.col("count")).alias("_shift")
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(key))
    return (
        bucketed.join(F.broadcast(shifts), "_bucket")
        .withColumn(name, F.col("_shift") + inside)
        .drop("_bucket", "_shift")
    )


def null_safe_class(label: str) -> Column:
    """The label as a join key that null labels share too (joins drop null keys)."""
    return F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))


def seeded_hash(row_id: Column, seed: int) -> Column:
    """Fixed pseudo-random key per row id: the same order on every run and retry."""
    return F.md5(F.concat(F.lit(f"{seed}-"), row_id.cast("string")))


def hash_rank_cutoffs(df: DataFrame, label: str, row_id: str, seed: int, quota) -> DataFrame:
    """(label, n, cutoff): the hash up to which a class holds ``quota(n)`` rows.

    Ranking a class takes no sort of its rows: counts per leading hash digits find the slice
    where the quota ends, and only that slice (1/4096 of a class) is ranked. A class whose
    quota covers all its rows gets the highest possible cutoff, an empty quota the lowest.
    """
    keyed = df.select(
        F.col(label).alias("label"), seeded_hash(F.col(row_id), seed).alias("h")
    ).withColumn("slice", F.substring("h", 1, 3))
    slices = keyed.groupBy("label", "slice").count()
    running = W.partitionBy("label").orderBy("slice")  # at most 4096 rows per class
    placed = slices.select(
        "label",
        "slice",
        F.sum("count").over(running).alias("upto"),
        (F.sum("count").over(running) - F.col("count")).alias("before"),
        F.sum("count").over(W.partitionBy("label")).alias("n"),
    ).withColumn("quota", quota(F.col("n")).cast("bigint"))
    ends = placed.filter(
        "quota > 0 and quota < n and before < quota and quota <= upto"
    ).select("label", "slice", "n", (F.col("quota") - F.col("before")).alias("left_over"))
    rank = F.row_number().over(W.partitionBy("label", "slice").orderBy("h"))
    cut = (
        attach_class_table(keyed, ends, ["label", "slice"])
        .withColumn("rank", rank)
        .filter("rank = left_over")
        .select("label", "n", F.col("h").alias("cutoff"))
    )
    whole = (
        placed.filter("quota <= 0 or quota >= n")
        .groupBy("label")
        .agg(F.max("n").alias("n"), F.max("quota").alias("quota"))
        .select("label", "n", F.when(F.col("quota") <= 0, "").otherwise("~").alias("cutoff"))
    )
    return cut.unionByName(whole)
