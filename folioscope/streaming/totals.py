"""Period totals per category over a stream of dated amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def period_totals(
    stream: DataFrame, period: str = "7 days", lateness: str | None = None
) -> DataFrame:
    """(period_start, period_end, income, expense, potential, n) per tumbling window.

    Expects ``ts``, ``category``, ``cents``. Without ``lateness`` every row counts and the state keeps one row per
    period; with it rows later than the watermark are dropped and old periods leave the state.
    """

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("category") == name, F.col("cents"))), F.lit(0))

    rows = stream if lateness is None else stream.withWatermark("ts", lateness)
    return (
        rows.groupBy(F.window("ts", period).alias("w"))
        .agg(
            total("income").alias("income"),
            total("expense").alias("expense"),
            total("potential_income").alias("potential"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            F.col("w.start").alias("period_start"),
            F.col("w.end").alias("period_end"),
            "income",
            "expense",
            "potential",
            "n",
        )
    )


def write_period_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the periods that each batch changed, open ones too, into a folder per batch.

    A batch that is run again overwrites its own folder, so the table is the same after any retry.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        totals.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_period_totals(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every period."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in ("batch", "period_start", "period_end")]
    last = rows.groupBy("period_start", "period_end").agg(*[F.max_by(c, "batch").alias(c) for c in names])
    return last.select("period_start", "period_end", *names)
