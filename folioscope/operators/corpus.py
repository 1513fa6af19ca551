"""Set operations on labelled corpora: integrate, cap, split, augment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.functions.text import MIN_CLEAN_LENGTH, clean_training_text
from folioscope.operators.joins import (
    attach_class_table,
    hash_rank_cutoffs,
    null_safe_class,
    seeded_hash,
    with_computed,
)

SEED = 42


def clean_training_corpus(df: DataFrame, min_length: int = MIN_CLEAN_LENGTH) -> DataFrame:
    """Texts cleaned for training, those left too short dropped."""
    cleaned = with_computed(df, text=clean_training_text(F.col("text")))
    return cleaned.filter(F.length("text") >= min_length)


def text_key(text: Column) -> Column:
    """32-byte digest that stands for a text in shuffles; null counts as one text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("\0null")), 256))


def first_of_each_text(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per distinct text, the first by ``order``.

    ``min_by`` combines copies inside each map task, so a text that makes up a third of the
    rows reaches its reducer as one row per task.
    """
    row = F.struct(*df.columns)
    return (
        df.groupBy(text_key(F.col("text")).alias("_key"))
        .agg(F.min_by(row, F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def integrate_dedup(existing: DataFrame, new: DataFrame, position: str = "pos") -> DataFrame:
    """Existing and new rows, each text once; existing rows win, then earlier positions."""
    both = existing.withColumn("_rank", F.lit(0)).unionByName(
        new.withColumn("_rank", F.lit(1)), allowMissingColumns=True
    )
    return first_of_each_text(both, ["_rank", position]).drop("_rank")


def integration_report(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Counts before and after integration and the duplicates removed."""
    texts = existing.select("text", F.lit(0).alias("new")).unionByName(new.select("text", F.lit(1).alias("new")))
    return texts.agg(
        F.count_if(F.col("new") == 0).alias("existing_rows"),
        F.count_if(F.col("new") == 1).alias("new_rows"),
        F.count_distinct(text_key(F.col("text"))).alias("final_rows"),
    ).withColumn("duplicates_removed", F.expr("existing_rows + new_rows - final_rows"))


def append_no_dedup(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def cap_per_class(
    df: DataFrame, label: str = "label", row_id: str = "doc_id", n: int = 2000, seed: int = SEED
) -> DataFrame:
    """At most ``n`` pseudo-random rows per label.

    Only (label, id) takes part in finding the cutoffs; the wide rows are filtered against
    one cutoff per class where they lie.
    """
    cutoffs = hash_rank_cutoffs(df, label, row_id, seed, lambda size: F.least(size, F.lit(n)))
    cutoffs = cutoffs.select(F.col("label").alias(label), F.col("cutoff").alias("_cutoff"))
    return (
        attach_class_table(df, cutoffs, label)
        .filter(seeded_hash(F.col(row_id), seed) <= F.col("_cutoff"))
        .select(*df.columns)
    )


def shuffle_rank(df: DataFrame, row_id: str = "doc_id", seed: int = SEED, name: str = "shuffle_rank") -> DataFrame:
    """Rank of each row in a seeded permutation, numbered slice by slice of the hash space."""
    h = seeded_hash(F.col(row_id), seed)
    keyed = df.withColumn("_h", h).withColumn("_s", F.substring("_h", 1, 4))
    sizes = df.select(F.substring(h, 1, 4).alias("_s")).groupBy("_s").count()
    # at most 65,536 rows
    shifts = sizes.select("_s", (F.sum("count").over(W.orderBy("_s")) - F.col("count")).alias("_shift"))
    inside = F.row_number().over(W.partitionBy("_s").orderBy("_h", row_id))
    return (
        keyed.join(F.broadcast(shifts), "_s")
        .withColumn(name, F.col("_shift") + inside)
        .drop("_s", "_h", "_shift")
    )


def shuffle_rows(df: DataFrame, row_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Rows in seeded order: range partitions of the hash, each sorted."""
    h = seeded_hash(F.col(row_id), seed)
    return df.withColumn("_h", h).repartitionByRange("_h").sortWithinPartitions("_h").drop("_h")


def stratified_split(
    df: DataFrame, label: str = "label", row_id: str = "doc_id", test_share: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Adds ``split``: the given share of every label to test, by seeded hash; null labels are a class too.

    If some class has fewer than two rows the split ignores labels. A class's test rows are
    those up to its cutoff hash, so no class is sorted or shuffled whole.
    """
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0]
    by = "_class"
    rows = df.withColumn(by, null_safe_class(label) if smallest is not None and smallest >= 2 else F.lit("all"))
    quota = lambda n: F.floor(n * test_share + 0.5)
    cutoffs = hash_rank_cutoffs(rows, by, row_id, seed, quota).select(
        F.col("label").alias(by), F.col("cutoff").alias("_cutoff")
    )
    in_test = seeded_hash(F.col(row_id), seed) <= F.col("_cutoff")
    split = attach_class_table(rows, cutoffs, by).withColumn("split", F.when(in_test, "test").otherwise("train"))
    return split.select(*df.columns, "split")


def drop_small_classes(df: DataFrame, label: str = "label", min_rows: int = 2) -> DataFrame:
    """Rows of labels that occur at least ``min_rows`` times."""
    large = df.groupBy(label).count().filter(F.col("count") >= min_rows).select(label)
    return attach_class_table(df, large, label, "left_semi")


def merge_and_drop_small(df: DataFrame, label: str = "label", min_rows: int = 5) -> DataFrame:
    """``purchase_orders`` becomes ``purchase_order``; classes under ``min_rows`` go."""
    merged = df.withColumn(
        label, F.when(F.col(label) == "purchase_orders", "purchase_order").otherwise(F.col(label))
    )
    return drop_small_classes(merged, label, min_rows)


def augment_min_samples(
    df: DataFrame,
    extra: DataFrame | None = None,
    classes: list[str] = lx.DOCUMENT_CLASSES,
    order: str = "pos",
    min_rows: int = 2,
) -> DataFrame:
    """(text, label): every known class filled up to ``min_rows`` with its first row or a
    placeholder sentence; the extra set follows as it is."""
    counts = df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("text", order).alias("first_text")
    )
    known = df.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    missing = (
        known.join(counts, "label", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .filter(F.col("n") < min_rows)
        .select(
            F.coalesce(
                "first_text", F.concat(F.lit("Example document of class "), F.col("label"))
            ).alias("text"),
            "label",
            F.explode(F.sequence(F.lit(1), (F.lit(min_rows) - F.col("n")).cast("int"))).alias("_i"),
        )
        .drop("_i")
    )
    out = df.select("text", "label").unionByName(missing)
    return out if extra is None else out.unionByName(extra.select("text", "label"))


def weighted_union(df: DataFrame, weight: Column) -> DataFrame:
    """Each row as often as its weight says."""
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), weight))).drop("_copy")


def take_first_n(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    return df.orderBy(order).limit(n)
