"""Data-quality profile of a labelled corpus.

Row-level facts are gathered in single aggregate passes; everything on labels starts from the
small table of label counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import lexicon as lx
from folioscope.functions.labels import label_problem
from folioscope.functions.patterns import BLANK, WORD, has, strip
from folioscope.operators.corpus import text_key
from folioscope.operators.joins import with_position

MEANINGFUL_WORD = rf"(?<![{WORD}])[A-Za-z]{{3,}}(?![{WORD}])"


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def _sampled(df: DataFrame, sample_rows: int | None, order: str) -> DataFrame:
    return df if sample_rows is None else df.orderBy(order).limit(sample_rows)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, missing, missing_percent) for every column, NaN counted as missing."""

    def missing(f: T.StructField) -> Column:
        empty = F.col(f.name).isNull()
        return empty | F.isnan(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else empty

    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(missing(f)).alias(f"m_{i}") for i, f in enumerate(df.schema)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.col(f"m_{i}").alias("missing"),
                _share(F.col(f"m_{i}"), F.col("n")).alias("missing_percent"),
            )
            for i, f in enumerate(df.schema)
        ]
    )
    return counts.select(F.inline(rows))


def short_text_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(strip(F.col("text")) == "").alias("empty_texts"),
        F.count_if(F.length("text") < 20).alias("short_texts"),
    ).withColumns(
        {
            "short_percent": _share(F.col("short_texts"), F.col("n")),
            "too_many_short": F.col("short_texts") > F.col("n") * 0.05,
        }
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows whose text has appeared before; digests, not texts, are shuffled."""
    return df.agg(
        (F.count(F.lit(1)) - F.count_distinct(text_key(F.col("text")))).alias("duplicate_texts")
    )


def length_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg(F.length("text")).alias("mean_length"),
        F.median(F.length("text")).alias("median_length"),
        F.min(F.length("text")).alias("min_length"),
        F.max(F.length("text")).alias("max_length"),
        F.count_if(F.length("text") > 5000).alias("very_long_texts"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("too_many_long", F.col("very_long_texts") > F.col("n") * 0.01)


def is_nonprintable(text: Column) -> Column:
    return text.rlike(r"[^\x20-\x7E\n\r\t]")


def is_meaningful(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MEANINGFUL_WORD)) >= 3


def nonprintable_count(df: DataFrame, sample_rows: int | None = None, order: str = "doc_id") -> DataFrame:
    """Rows with non-printable characters, flagged above 5% of the rows looked at."""
    return _sampled(df, sample_rows, order).agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(is_nonprintable(F.col("text"))).alias("nonprintable_texts")
    ).withColumn(
        "many_nonprintable",
        F.col("nonprintable_texts") > (F.col("checked") if sample_rows is None else F.lit(sample_rows)) * 0.05,
    )


def meaningful_ratio(
    df: DataFrame, sample_rows: int | None = None, denominator: int | None = None, order: str = "doc_id"
) -> DataFrame:
    """Rows with three or more words of three letters, flagged below 90%.

    ``sample_rows=1000, denominator=1000`` reads the first thousand rows and divides by a
    thousand even when there are fewer.
    """
    return _sampled(df, sample_rows, order).agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(is_meaningful(F.col("text"))).alias("meaningful_texts")
    ).withColumn(
        "meaningful_percent",
        _share(F.col("meaningful_texts"), F.col("checked") if denominator is None else F.lit(denominator)),
    ).withColumn("low_meaning", F.col("meaningful_percent") < 90)


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, percent) from the most frequent label down."""
    return (
        label_counts(df, label)
        .withColumn("percent", _share(F.col("n"), F.sum("n").over(W.partitionBy())))
        .orderBy(F.desc("n"), "label")
    )


def _extremes() -> list[Column]:
    frequent_first = F.struct(-F.col("n"), F.col("label"))
    return [
        F.min_by("label", frequent_first).alias("most_common"),
        F.max("n").alias("max_count"),
        F.max_by("label", frequent_first).alias("least_common"),
        F.min("n").alias("min_count"),
        F.try_divide(F.max("n"), F.min("n")).alias("ratio"),
    ]


def imbalance_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    return (
        label_counts(df, label)
        .agg(*_extremes())
        .withColumn(
            "imbalance",
            F.when(F.col("ratio") > 100, "severe").when(F.col("ratio") > 20, "moderate").otherwise("none"),
        )
    )


def small_classes(df: DataFrame, label: str = "label", below: int = 10) -> DataFrame:
    return label_counts(df, label).agg(
        F.count(F.lit(1)).alias("classes"), F.count_if(F.col("n") < below).alias("small_classes")
    )


def lint_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, problem) for each distinct label that is spelled inconsistently."""
    return (
        df.select(F.col(label).alias("label"))
        .distinct()
        .withColumn("problem", label_problem(F.col("label")))
        .filter("problem is not null")
    )


def source_profile(df: DataFrame, source: str = "source") -> DataFrame:
    return (
        df.groupBy(F.col(source).alias("source"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean_length"))
        .withColumn("percent", _share(F.col("n"), F.sum("n").over(W.partitionBy())))
    )


def neighbour_similarity(df: DataFrame, key: str = "doc_id", reach: int = 9, block: int = 1024) -> DataFrame:
    """(id_a, id_b, similarity): word-set Jaccard of every row and its next ``reach`` rows.

    Rows are numbered and cut into fixed blocks; the first rows of a block also travel with
    the block before it, so one shuffle serves all comparisons and no block can grow hot.
    Words move as 64-bit hashes, each once per row; no text is shuffled.
    """
    words = F.filter(F.split(F.lower(F.col("text")), f"[{BLANK}]+"), lambda w: w != "")
    hashed = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    numbered = with_position(df.select(F.col(key).alias("id"), hashed.alias("words")), "id")
    home = F.floor((F.col("pos") - 1) / block)
    into = F.pmod(F.col("pos") - 1, F.lit(block))
    placed = numbered.withColumn(
        "_block",
        F.explode(
            F.when((into < reach) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
        ),
    ).withColumn("_guest", F.col("_block") < home)
    following = W.partitionBy("_block").orderBy("pos").rowsBetween(1, reach)
    pairs = (
        placed.withColumn("_next", F.collect_list(F.struct("id", "words")).over(following))
        .filter("not _guest")
        .select(F.col("id").alias("id_a"), "words", F.explode("_next").alias("b"))
        .filter("size(words) > 0 and size(b.words) > 0")
    )
    shared = F.size(F.array_intersect("words", "b.words"))
    return pairs.select(
        "id_a",
        F.col("b.id").alias("id_b"),
        (shared / (F.size("words") + F.size("b.words") - shared)).alias("similarity"),
    )


def near_duplicate_pairs(
    df: DataFrame, key: str = "doc_id", reach: int = 9, threshold: float = 0.8,
    first_rows: int | None = None, allowed: float = 5 / 900,
) -> DataFrame:
    """Similar pairs among neighbouring rows, flagged where their share of the compared pairs is above ``allowed``.

    ``first_rows=100`` compares only the first hundred rows with their followers: about 900 pairs, of which five may be similar.
    """
    rows = df if first_rows is None else df.orderBy(key).limit(first_rows + reach)
    pairs = neighbour_similarity(rows, key, reach)
    if first_rows is not None:
        heads = rows.orderBy(key).limit(first_rows).select(F.col(key).alias("id_a"))
        pairs = pairs.join(heads, "id_a", "left_semi")
    return pairs.agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(F.col("similarity") > threshold).alias("similar_pairs"),
        F.max("similarity").alias("max_similarity"),
    ).withColumn("near_duplicates", F.col("similar_pairs") > allowed * F.col("compared"))


def ocr_artifact_counts(df: DataFrame) -> DataFrame:
    """(artifact, n): rows matching each artefact pattern."""
    counts = df.agg(
        *[F.count_if(has(F.col("text"), p, False)).alias(name) for name, p in lx.OCR_PATTERNS.items()]
    )
    return counts.unpivot([], list(lx.OCR_PATTERNS), "artifact", "n")


def size_estimate(df: DataFrame) -> DataFrame:
    return df.agg((F.count(F.lit(1)) * F.avg(F.length("text")) / 1048576).alias("megabytes"))


def corpus_facts(df: DataFrame) -> DataFrame:
    """One row with every text-level count the grade needs, in one pass over the corpus."""
    ocr = reduce(lambda a, b: a | b, [has(F.col("text"), p, False) for p in lx.OCR_PATTERNS.values()])
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in df.columns],
        F.avg(F.length("text")).alias("mean_length"),
        F.count_if(strip(F.col("text")) == "").alias("empty_texts"),
        F.count_if(F.length("text") < 20).alias("short_texts"),
        F.count_if(F.length("text") > 5000).alias("long_texts"),
        F.count_if(is_nonprintable(F.col("text"))).alias("nonprintable"),
        F.count_if(is_meaningful(F.col("text"))).alias("meaningful"),
        F.count_if(ocr).alias("ocr_texts"),
        F.count_distinct(text_key(F.col("text"))).alias("distinct_texts"),
    )


def quality_grade(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: number of issues, grade, issues and advice (arrays), overview figures."""
    columns = df.columns
    labels = label_counts(df).agg(
        F.count(F.lit(1)).alias("labels"),
        F.try_divide(F.max("n"), F.min("n")).alias("ratio"),
        F.count_if(F.col("n") < 10).alias("small"),
        F.count_if(label_problem(F.col("label")).isNotNull()).alias("misspelled"),
    )
    near = near_duplicate_pairs(df, key).select("near_duplicates")
    facts = (
        corpus_facts(df)
        .withColumns({"_l": labels.select(F.struct("*")).scalar(), "near_duplicates": near.scalar()})
        .select("*", "_l.*")
    )
    n = F.col("n")
    checks = [(F.col(f"missing_{c}") > 0, f"Missing values in {c}") for c in columns] + [
        (F.col("empty_texts") > 0, "Empty text fields found"),
        (F.col("short_texts") > n * 0.05, "Too many very short texts"),
        (F.col("distinct_texts") < n, "Duplicate texts found"),
        (F.col("long_texts") > n * 0.01, "Too many extremely long texts"),
        (F.col("nonprintable") > n * 0.05, "Many samples contain non-printable characters"),
        (F.col("meaningful") < n * 0.9, "Low percentage of meaningful text content"),
        (F.col("ratio") > 100, "Severe label imbalance detected"),
        ((F.col("ratio") > 20) & (F.col("ratio") <= 100), "Moderate label imbalance detected"),
        (F.col("small") > 0, "Classes with very few samples"),
        (F.col("misspelled") > 0, "Label formatting inconsistencies"),
        (F.col("near_duplicates"), "Potential near-duplicate texts"),
        (F.col("ocr_texts") > 0, "OCR artifacts detected"),
    ]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in checks]))
    found = lambda text: F.array_contains("issues", text)
    advice = [
        (F.size("issues") == 0, "Your dataset is excellent and ready for training!"),
        (F.size("issues") == 0, "Proceed with model training using this high-quality data."),
        (found("Duplicate texts found"), "Remove duplicate texts to prevent overfitting"),
        (found("Empty text fields found"), "Remove or fix empty text entries"),
        (found("OCR artifacts detected"), "Clean OCR artifacts for better text quality"),
        (found("Label formatting inconsistencies"), "Standardize label formatting (lowercase, underscores)"),
        (F.exists("issues", lambda i: i.contains("imbalance")), "Consider data augmentation for underrepresented classes"),
    ]
    count = F.size("issues")
    return facts.withColumn("issues", issues).select(
        "n",
        "labels",
        "mean_length",
        (n * F.col("mean_length") / 1048576).alias("megabytes"),
        count.alias("issue_count"),
        F.when(count == 0, lx.GRADES[0]).when(count <= 2, lx.GRADES[1]).when(count <= 5, lx.GRADES[2])
        .otherwise(lx.GRADES[3]).alias("grade"),
        "issues",
        F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in advice])).alias("advice"),
    )


def rank_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """(rank, label, n, percent) with a TOTAL row of null rank."""
    counts = label_counts(df, label)
    ranked = counts.select(
        F.row_number().over(W.orderBy(F.desc("n"), "label")).alias("rank"),
        "label",
        "n",
        _share(F.col("n"), F.sum("n").over(W.partitionBy())).alias("percent"),
    )
    total = counts.agg(F.sum("n").alias("n")).select(
        F.lit(None).cast("int").alias("rank"), F.lit("TOTAL").alias("label"), "n", F.lit(100.0).alias("percent")
    )
    return ranked.unionByName(total)


def size_bands(df: DataFrame, label: str = "label") -> DataFrame:
    """(band, classes, n): large from 1000 rows, medium from 100, else small."""
    band = F.when(F.col("n") >= 1000, "large").when(F.col("n") >= 100, "medium").otherwise("small")
    return label_counts(df, label).groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n")
    )


def balance_status(df: DataFrame, label: str = "label") -> DataFrame:
    ratio = F.col("ratio")
    return label_counts(df, label).agg(*_extremes()).withColumn(
        "status",
        F.when(ratio <= 10, "EXCELLENT").when(ratio <= 50, "GOOD").when(ratio <= 100, "FAIR").otherwise("POOR"),
    )


def training_readiness(df: DataFrame, label: str = "label") -> DataFrame:
    ready, classes, total = F.col("ready_classes"), F.col("classes"), F.col("total")
    return label_counts(df, label).agg(
        F.count_if(F.col("n") >= 50).alias("ready_classes"),
        F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("total"),
        F.avg("n").alias("mean_per_class"),
    ).withColumn(
        "readiness",
        F.when((ready == classes) & (total >= 5000), "EXCELLENT")
        .when((ready >= classes * 0.8) & (total >= 3000), "GOOD")
        .when((ready >= classes * 0.6) & (total >= 1000), "FAIR")
        .otherwise("POOR"),
    )


def compare_distributions(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """(label, before, after, difference) over the labels of either side."""
    a = label_counts(before, label).withColumnRenamed("n", "before")
    b = label_counts(after, label).withColumnRenamed("n", "after")
    return a.join(b, "label", "full_outer").select(
        "label",
        F.coalesce("before", F.lit(0)).alias("before"),
        F.coalesce("after", F.lit(0)).alias("after"),
        (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("difference"),
    )


def validate_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Same row count and label counts after cleaning; JSON rows still left."""
    counts = compare_distributions(before, after).agg(
        F.sum("before").alias("rows_before"),
        F.sum("after").alias("rows_after"),
        F.count_if(F.col("difference") != 0).alias("labels_changed"),
    )
    left = after.agg(F.count_if(F.col("text").rlike(rf"^[{BLANK}]*\{{")).alias("json_rows_left"))
    return counts.withColumn("json_rows_left", left.scalar()).withColumn(
        "preserved", F.expr("rows_before = rows_after and labels_changed = 0")
    )


def validate_ingest(df: DataFrame) -> DataFrame:
    """Rows, mean length, label count and the two warnings of an ingest run."""
    return label_lengths(df).agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum("chars"), F.sum("n")).alias("mean_length"),
        F.count(F.lit(1)).alias("labels"),
    ).withColumns(
        {"texts_short": F.col("mean_length") < 50, "single_label": F.col("labels") < 2}
    )


def label_lengths(df: DataFrame) -> DataFrame:
    """(label, n, chars, min_length, wordy, null_texts): the corpus folded to one row per label."""
    return df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("text")).alias("chars"),
        F.min(F.length("text")).alias("min_length"),
        F.count_if(F.col("text").rlike("[A-Za-z]{3,}")).alias("wordy"),
        F.count_if(F.col("text").isNull()).alias("null_texts"),
    )


def validate_samples(df: DataFrame) -> DataFrame:
    """Valid if texts average 50 characters, 90% hold a word and there are two labels."""
    return label_lengths(df).agg(
        F.try_divide(F.sum("chars"), F.sum("n")).alias("mean_length"),
        _share(F.sum("wordy"), F.sum("n")).alias("meaningful_percent"),
        F.count(F.lit(1)).alias("labels"),
    ).withColumn(
        "valid", F.expr("mean_length >= 50 and meaningful_percent >= 90 and labels >= 2")
    )


def validate_cleaned(df: DataFrame) -> DataFrame:
    """Remaining issues of a cleaned corpus; passed if none."""
    facts = label_lengths(df).agg(
        F.sum("n").alias("n"),
        F.count("label").alias("labels"),
        F.try_divide(F.sum("chars"), F.sum("n") - F.sum("null_texts")).alias("mean_length"),
        F.min("min_length").alias("min_length"),
        F.try_divide(F.max(F.when(F.col("label").isNotNull(), F.col("n"))), F.min(F.when(F.col("label").isNotNull(), F.col("n")))).alias("ratio"),
        F.sum("null_texts").alias("null_texts"),
        F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(0)).alias("null_labels"),
    )
    checks = [
        (F.col("null_texts") > 0, "Null texts found"),
        (F.col("null_labels") > 0, "Null labels found"),
        (F.col("min_length") < 20, "Very short texts still present"),
        (F.col("mean_length") < 100, "Average text length seems low"),
        (F.col("ratio") > 50, "Severe imbalance still present"),
    ]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))
    return facts.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0).drop(
        "null_texts", "null_labels"
    )


def top_n_with_others(df: DataFrame, label: str = "label", n: int = 8) -> DataFrame:
    """(label, n, percent): the ``n`` largest classes and all the rest as Others."""
    ranked = label_counts(df, label).withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "label")))
    name = F.when(F.col("rank") <= n, F.col("label")).otherwise("Others")
    return (
        ranked.groupBy(name.alias("label"))
        .agg(F.sum("n").alias("n"))
        .withColumn("percent", _share(F.col("n"), F.sum("n").over(W.partitionBy())))
    )


def length_boxplot(df: DataFrame, label: str = "label", top: int = 6) -> DataFrame:
    """(label, n, q1, median, q3) of the text lengths of the largest classes.

    Percentile keeps a count per distinct length and merges partial counts, so a hot label
    is folded on the map side.
    """
    counts = label_counts(df, label)
    largest = counts.orderBy(F.desc("n"), "label").limit(top).select("label")
    rows = df.select(F.col(label).alias("label"), F.length("text").alias("chars"))
    return (
        rows.join(F.broadcast(largest), "label", "left_semi")  # `top` rows
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.percentile("chars", [0.25, 0.5, 0.75]).alias("q"))
        .select("label", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    )


def growth_by_source(df: DataFrame, source: str = "source") -> DataFrame:
    """(source, n, corpus_size): corpus size as sources are added one by one."""
    counts = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    # one row per source
    return counts.withColumn(
        "corpus_size", F.sum("n").over(W.orderBy("source").rowsBetween(W.unboundedPreceding, 0))
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """(label, n, labels, total, mean_length): distribution with the totals on every row."""
    everything = W.partitionBy()  # over one row per label
    return label_lengths(df).select(
        "label",
        "n",
        F.count(F.lit(1)).over(everything).alias("labels"),
        F.sum("n").over(everything).alias("total"),
        F.try_divide(F.sum("chars").over(everything), F.sum("n").over(everything)).alias("mean_length"),
    )
