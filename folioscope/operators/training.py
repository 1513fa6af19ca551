"""Features, training, scoring and evaluation of text classifiers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    Normalizer,
    RegexTokenizer,
    StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import lexicon as lx
from folioscope.functions.patterns import WORD, let
from folioscope.functions.rules import (
    commercial_decision,
    confidence_flag,
    decision_list,
    final_prediction,
    hybrid_decision,
    predict,
    rule_score,
)
from folioscope.functions.text import clean_text_multilingual, strip_accents, truncate_for_embedding
from folioscope.operators import terms
from folioscope.operators.joins import attach_class_table, null_safe_class, with_computed
from folioscope.operators.stages import PlattScaling, PlattScalingModel, SublinearIdf, TermCounter
from folioscope.session import discard, kept

TOKEN = rf"[{WORD}]{{2,}}"
VOCABULARY = 10_000
SEED = 42
NUMBERS_PER_TASK = 2_000_000


def grams(text: Column, stopwords: Iterable[str] = ()) -> Column:
    """Lower-cased words of two or more characters and the pairs of neighbours among them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(*stopwords))
    return let(
        words,
        lambda w: F.concat(
            w,
            F.transform(
                F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))),
                lambda first, i: F.concat(first, F.lit(" "), F.get(w, i + 1)),
            ),
        ),
    )


def term_counts(terms: Column) -> Column:
    """Array of (term, tf): the runs of the sorted terms."""
    ordered = F.sort_array(terms)  # a native comparison, where array_sort runs a lambda

    def runs(t: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
        return let(
            begins,
            lambda at: F.transform(
                at,
                lambda i, k: F.struct(
                    F.get(t, i - 1).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t) + 1) - i).cast("bigint").alias("tf")
                ),
            ),
        )

    return let(ordered, lambda t: F.when(F.size(t) > 0, runs(t)))


def count_terms(stopwords: Iterable[str] = (), most: int = 100_000):
    """Batches of (id, lower-cased text) to rows (id, term, tf) of the terms of :func:`grams`, some ``most`` rows at a time.

    The worker imports only the standard library and pyarrow, so the function can be shipped without this package.
    """
    dropped = frozenset(stopwords)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from collections import Counter

        import pyarrow as pa

        words = re.compile(r"\w{2,}").findall

        def rows(ids, at, terms, uses):
            columns = [ids.take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(uses, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["id", "term", "tf"])

        for batch in batches:
            ids, at, terms, uses = batch.column(0), [], [], []
            for i, text in enumerate(batch.column(1)):
                if (t := text.as_py()) is None:
                    continue
                found = [w for w in words(t) if w not in dropped] if dropped else words(t)
                counts = Counter(found)
                counts.update(map(" ".join, zip(found, found[1:])))
                at += [i] * len(counts)
                terms += counts
                uses += counts.values()
                if len(terms) >= most:
                    yield rows(ids, at, terms, uses)
                    at, terms, uses = [], [], []
            if terms:
                yield rows(ids, at, terms, uses)

    return count


def tfidf_features(
    df: DataFrame,
    row_id: str = "doc_id",
    max_features: int = VOCABULARY,
    min_df: int = 2,
    max_df: float = 0.9,
    stopwords: Iterable[str] = (),
) -> DataFrame:
    """(id, term, weight): sublinear tf times smoothed idf, each document at unit length.

    A row is a document and its id is unique. Terms are counted where the text is read, so no text is shuffled: what moves is
    one row per term and map task for the document frequencies, and ids with term numbers and weights for the norms. The
    vocabulary has at most ``max_features`` rows, which bounds what is broadcast; it is worked out when this is called.
    """
    texts = df.select(F.col(row_id).alias("id"), F.lower("text").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    counts = texts.mapInArrow(count_terms(stopwords), f"id {kind}, term string, tf bigint")
    docs = df.agg(F.count(F.lit(1))).scalar()
    vocabulary = (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("uses"), F.count(F.lit(1)).alias("df"))
        .withColumn("docs", docs)
        .filter((F.col("df") >= min_df) & (F.col("df") <= F.col("docs") * max_df))
        .orderBy(F.desc("uses"), "term")
        .limit(max_features)
        .select("term", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    )
    numbered = vocabulary.select("term", "idf", (F.row_number().over(W.orderBy("term"))).alias("number"))  # max_features rows
    numbered = kept(numbered, "vocabulary")  # joined twice, counted once
    weighted = counts.join(F.broadcast(numbered), "term").select(
        "id", "number", ((F.log("tf") + 1) * F.col("idf")).alias("w")
    )
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    shares = weighted.select("id", "number", (F.col("w") / length).alias("weight"))
    return shares.join(F.broadcast(numbered.select("number", "term")), "number").select("id", "term", "weight")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): total over classes times class size."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy()  # over one row per class
    return counts.withColumn(
        "weight",
        F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n")),
    )


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``class_weight``; rows without a label are a class of their own."""
    named = df.withColumn("_class", null_safe_class(label))
    weights = class_weights(named, "_class").select(F.col("label").alias("_class"), F.col("weight").alias("class_weight"))
    return attach_class_table(named, weights, "_class").drop("_class")


def text_features(vocabulary: int = VOCABULARY, min_df: float = 2.0, max_df: float | None = 0.9) -> list:
    """Pipeline stages from ``text`` to ``features``, the weights of :func:`tfidf_features` as vectors.

    ``max_df`` is a share below one; None keeps terms however common.
    """
    return [
        TermCounter(inputCol="text", outputCol="tf", vocabSize=vocabulary, minDF=min_df, maxDF=max_df),
        SublinearIdf(inputCol="tf", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="features"),
    ]


def _label_index() -> StringIndexer:
    return StringIndexer(
        inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"
    )


def _fit_on_features(df: DataFrame, features: list, classifier, keep: list[str], more=lambda vectors: []) -> PipelineModel:
    """Fit the feature stages, keep their vectors, fit the classifier and what ``more`` makes of the vectors on those.

    Texts are read for the vocabulary and for the counts of its terms; those are stored, and the weights are learnt and made from
    them. Optimisers hold blocks of the vectors in memory; the vectors themselves stay on disk beside them.
    """
    rows = df.select("label", "text", *keep)
    counting = Pipeline(stages=[_label_index(), features[0]]).fit(rows)
    counts = kept(counting.transform(rows).drop("label", "text"), "counts")
    weighing = Pipeline(stages=features[1:]).fit(counts)
    vectors = weighing.transform(counts).select("label_index", "features", *keep).persist(StorageLevel.DISK_ONLY)
    try:
        fitted = [classifier.fit(vectors), *more(vectors)]
    finally:
        vectors.unpersist()
    discard(counts)
    return PipelineModel(stages=[*counting.stages, *weighing.stages, *fitted])


def train_linear_classifier(
    df: DataFrame, vocabulary: int = VOCABULARY, c: float = 1.5, max_iter: int = 50, parallelism: int = 4, calibration_folds: int = 0
) -> PipelineModel:
    """One-versus-rest linear SVMs with balanced class weights.

    ``c`` weighs the data against the penalty, so the penalty per row is 1 / (c n). With ``calibration_folds`` the decision
    values are turned into probabilities by sigmoids, fitted on rows that a fold's classifier has not seen.
    """

    def classifier(rows: int) -> OneVsRest:
        svm = LinearSVC(maxIter=max_iter, regParam=1.0 / (c * max(rows, 1)))
        return OneVsRest(
            classifier=svm, labelCol="label_index", featuresCol="features", weightCol="class_weight",
            rawPredictionCol="rawPrediction", parallelism=parallelism,
        )

    n = df.count()
    if not calibration_folds:
        return _fit_on_features(with_class_weight(df), text_features(vocabulary), classifier(n), ["class_weight"])
    held_out: list[DataFrame] = []

    def calibrated(vectors: DataFrame) -> list:
        fold = F.pmod(F.xxhash64(F.lit(SEED), "row_key"), F.lit(calibration_folds))  # rows of one text share a fold
        share = (calibration_folds - 1) / calibration_folds
        for k in range(calibration_folds):
            fitted = classifier(int(n * share)).fit(vectors.filter(fold != k))
            held_out.append(fitted.transform(vectors.filter(fold == k)).select("label_index", "rawPrediction"))
        unseen = held_out[0]
        for part in held_out[1:]:
            unseen = unseen.unionByName(part)
        return [PlattScaling().fit(unseen)]

    keyed = with_class_weight(df).withColumn("row_key", F.xxhash64("text"))
    return _fit_on_features(keyed, text_features(vocabulary), classifier(n), ["class_weight", "row_key"], calibrated)


def train_logistic(df: DataFrame, vocabulary: int = 5_000, max_iter: int = 1_000) -> PipelineModel:
    """Multinomial logistic regression with unit penalty over the whole data."""
    classifier = LogisticRegression(
        labelCol="label_index", featuresCol="features", family="multinomial", maxIter=max_iter,
        regParam=1.0 / max(df.count(), 1),
    )
    return _fit_on_features(df, text_features(vocabulary, 1.0, None), classifier, [])


def grid_search(
    df: DataFrame,
    vocabularies: tuple[int, ...] = (5_000, 10_000, 15_000),
    penalties: tuple[float, ...] = (0.001, 0.01, 0.1),
    min_dfs: tuple[float, ...] = (3.0, 5.0, 7.0),
    max_dfs: tuple[float, ...] = (0.7, 0.8, 0.9),
    max_iter: int = 100,
    folds: int = 3,
    parallelism: int = 8,
    seed: int = 42,
):
    """Cross-validated choice of vocabulary size, document-frequency limits and penalty by accuracy.

    The grid is the reference's but for its kernels: those other than the linear one have no distributed form and are no axis of it.
    Texts are read twice for all settings and folds, for the uses of terms per fold and for the counts of all vocabularies' terms; the
    vectors of a setting are picked and weighed from those counts. Settings that come to the same terms in a fold share their fits.
    A setting without a term has no accuracy. The model returned takes texts.
    """
    counter, weights, scale = text_features()
    classifier = LogisticRegression(labelCol="label_index", featuresCol="features", maxIter=max_iter)
    evaluator = MulticlassClassificationEvaluator(labelCol="label_index", metricName="accuracy")
    grid = (
        ParamGridBuilder()
        .addGrid(counter.vocabSize, list(vocabularies))
        .addGrid(counter.minDF, list(min_dfs))
        .addGrid(counter.maxDF, list(max_dfs))
        .addGrid(classifier.regParam, list(penalties))
        .build()
    )
    fold = F.least(F.floor(F.rand(seed) * folds), F.lit(folds - 1)).cast("int").alias("fold")
    rows = kept(df.select("text", "label", fold), "rows")  # folds are fixed from here on
    of_fold = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for c in ("uses", "df") for k in range(folds)]
    every = [F.sum(c).alias(c) for c in ("uses", "df")]
    uses = kept(terms.term_uses(rows, folds).groupBy("term").agg(*every, *of_fold), "uses")
    texts = uses.filter("term = ''").first()

    def others(k: int) -> int:
        return texts["df"] - texts[f"df_{k}"] if texts else 0

    def most_used(k: int, min_df: float, max_df: float) -> list[tuple[str, int]]:
        seen = uses.select("term", *[(F.col(c) - F.col(f"{c}_{k}")).alias(c) for c in ("uses", "df")])
        return [(r["term"], r["df"]) for r in terms.chosen(seen, others(k), max(vocabularies), min_df, max_df).collect()]

    limits = [(k, least, most) for k in range(folds) for least in min_dfs for most in max_dfs]
    with ThreadPool(parallelism) as pool:
        found = dict(zip(limits, pool.map(inheritable_thread_target(df.sparkSession)(lambda x: most_used(*x)), limits)))
    discard(uses)
    union = sorted({t for chosen in found.values() for t, _ in chosen})
    place = {t: i for i, t in enumerate(union)}
    shared: dict[tuple, list[int]] = {}  # fold and terms to the grid's settings
    frequency: dict[tuple, list[int]] = {}
    for i, setting in enumerate(grid):
        for k in range(folds):
            picked = found[k, setting[counter.minDF], setting[counter.maxDF]][: setting[counter.vocabSize]]
            own = sorted((place[t], n) for t, n in picked)
            key = (k, tuple(p for p, _ in own))
            shared.setdefault(key, []).append(i)
            frequency[key] = [n for _, n in own]
    if not any(own for _, own in shared):
        raise ValueError("The vocabulary size should be > 0. Lower minDF as necessary.")
    vector = T.StructType([T.StructField("label", df.schema["label"].dataType), T.StructField("fold", T.IntegerType()), T.StructField("tf", VectorUDT())])
    counted = rows.select("label", "fold", terms.shown(F.col("text")).alias("tf")).mapInArrow(terms.counts_of(union, 2), vector)
    counts = kept(counted, "counts")
    numbers = counts.agg(F.sum(F.size(F.unwrap_udt("tf")["indices"]))).first()[0] or 0
    tasks = max(math.ceil(numbers / NUMBERS_PER_TASK), 1)  # a pass over few rows in many tasks is mostly their start
    indexes = [_label_index().fit(counts.filter(F.col("fold") != k)) for k in range(folds)]

    def accuracies(key: tuple) -> dict[float, float]:
        k, own = key
        if not own:
            return dict.fromkeys(penalties, float("nan"))
        idf, to = np.zeros(len(union)), np.full(len(union), -1)
        idf[list(own)] = np.log((1 + others(k)) / (1 + np.array(frequency[key]))) + 1
        to[list(own)] = np.arange(len(own))
        indexed = indexes[k].transform(counts).select("fold", "label_index", F.unwrap_udt("tf").alias("features"))
        schema = T.StructType([indexed.schema["fold"], indexed.schema["label_index"], T.StructField("features", VectorUDT())])
        vectors = indexed.coalesce(tasks).mapInArrow(terms.weighed(idf.tolist(), 2, to.tolist(), len(own)), schema).persist(StorageLevel.DISK_ONLY)
        train, held_out = vectors.filter(F.col("fold") != k), vectors.filter(F.col("fold") == k)
        scores = {p: evaluator.evaluate(classifier.copy({classifier.regParam: p}).fit(train).transform(held_out)) for p in penalties}
        vectors.unpersist()
        return scores

    with ThreadPool(parallelism) as pool:
        scored = pool.map(inheritable_thread_target(df.sparkSession)(accuracies), list(shared), chunksize=1)
    discard(counts)
    metrics = np.full((folds, len(grid)), np.nan)
    for (k, own), scores in zip(shared, scored):
        for i in shared[k, own]:
            metrics[k, i] = scores[grid[i][classifier.regParam]]
    mean = metrics.mean(axis=0)
    best = grid[int(np.nanargmax(mean))]
    features = text_features(best[counter.vocabSize], best[counter.minDF], best[counter.maxDF])
    model = _fit_on_features(rows, features, classifier.copy({classifier.regParam: best[classifier.regParam]}), [])
    discard(rows)
    validator = CrossValidator(
        estimator=Pipeline(stages=[_label_index(), counter, weights, scale, classifier]),
        estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, parallelism=parallelism, seed=seed,
    )
    return validator._copyValues(CrossValidatorModel(model, mean.tolist(), None, metrics.std(axis=0).tolist()))


def grid_results(df: DataFrame, model) -> DataFrame:
    """(setting, accuracy) of a fitted grid search."""
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)), float(a))
        for m, a in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]
    return df.sparkSession.createDataFrame(rows, "setting string, accuracy double")


def softmax(values: Column) -> Column:
    """Shares from decision values, the largest subtracted first."""
    return let(
        F.transform(values, lambda v: F.exp(v - F.array_max(values))),
        lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)),
    )


def score_batch(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``prediction``, ``confidence`` and ``confidence_scores`` (class to share).

    Calibrated models give their probabilities. Models without probabilities get the sigmoid of the second class's decision
    value where there are two classes, else the softmax of the decision values.
    """
    labels = model.stages[0].labels
    scored = model.transform(df)
    if any(isinstance(s, PlattScalingModel) for s in model.stages):
        shares = F.col("calibrated")
    elif "probability" in scored.columns:
        shares = vector_to_array("probability")
    elif len(labels) == 2:
        shares = let(1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])), lambda p: F.array(1 - p, p))
    else:
        shares = softmax(vector_to_array("rawPrediction"))
    names = F.array(*[F.lit(x) for x in labels])
    kept = [c for c in df.columns if c != "prediction"]
    return scored.select(
        *kept,
        F.get(names, F.col("prediction").cast("int")).alias("predicted"),
        F.map_from_arrays(names, shares).alias("confidence_scores"),
    ).select(
        *kept,
        F.col("predicted").alias("prediction"),
        F.try_element_at("confidence_scores", F.col("predicted")).alias("confidence"),
        "confidence_scores",
    )


CLASSIFIED = (
    "model_prediction", "model_confidence", "prediction", "confidence", "confidence_scores", "rule", "rule_by_score",
    "final_prediction", "confidence_level", "hybrid", "decision",
)


def classify_documents(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds what a trained model and the rules make of every text.

    ``model_prediction`` and ``model_confidence`` are the model's own; ``prediction``, ``confidence`` and ``confidence_scores`` are its
    scores after the evidence steps; ``rule`` is the decision list's type and ``rule_by_score`` that of the keyword points.
    ``final_prediction`` and ``confidence_level`` follow the rule first, ``hybrid`` the confident model first, and ``decision`` is the type
    and confidence reported. Null and empty texts count as texts without a word; a model that lacks a type gives it no share.
    Rows without a label, or with one the model has not seen, are classified as well; columns named as these results are replaced.
    """
    kept = [c for c in df.columns if c not in CLASSIFIED]
    texts = df.select(*kept).withColumn("text", F.coalesce("text", F.lit("")))
    own = "_label"
    while own in df.columns:
        own += "_"
    # the model's label stage drops rows whose label it does not know, so it is shown one that it does
    shown = texts.withColumnRenamed("label", own).withColumn("label", F.lit(model.stages[0].labels[0]))
    scored = score_batch(model, shown).drop("label")
    steps = predict(F.col("text"), F.col("confidence_scores"), F.col("prediction"))
    rows = scored.withColumnRenamed(own, "label").select(
        *kept,
        F.col("prediction").alias("model_prediction"),
        F.col("confidence").alias("model_confidence"),
        F.inline(F.array(steps)),
    )
    rows = with_computed(
        rows,
        rule=decision_list(clean_text_multilingual(F.col("text"))),
        rule_by_score=rule_score(strip_accents(F.col("text"))),
    )
    prediction, confidence, rule = F.col("prediction"), F.col("confidence"), F.col("rule")
    return rows.withColumns(
        {
            "final_prediction": final_prediction(rule, prediction, confidence, F.col("confidence_scores")),
            "confidence_level": confidence_flag(confidence),
            "hybrid": hybrid_decision(prediction, confidence, F.col("rule_by_score")),
        }
    ).withColumn("decision", commercial_decision(rule, prediction, confidence, F.col("hybrid")))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support, accuracy): one row per class seen on either side."""
    counts = confusion_counts(df, label, prediction)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("claimed")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("claimed")),
            )
        ).alias("s"),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
    )
    per_class = sides.groupBy("s.class").agg(
        F.sum("s.actual").alias("support"),
        F.sum("s.claimed").alias("claimed"),
        (F.sum("hit") / 2).cast("bigint").alias("hits"),
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("claimed")), zero)
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), zero)
    everything = W.partitionBy()  # over one row per class
    return per_class.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero).alias("f1"),
        "support",
        F.try_divide(F.sum("hits").over(everything), F.sum("support").over(everything)).alias("accuracy"),
    )


def confusion_matrix(
    df: DataFrame,
    classes: list[str],
    label: str = "label",
    prediction: str = "prediction",
    normalize: bool = False,
) -> DataFrame:
    """One row per true class, one column per predicted class, listed classes only.

    The pivot ignores unlisted predictions and the join unlisted labels, so no filter repeats
    the work behind the prediction column.
    """
    table = df.groupBy(F.col(label).alias("label")).pivot(prediction, classes).agg(F.count(F.lit(1)))
    every = df.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    dense = every.join(table, "label", "left").na.fill(0, classes)
    if not normalize:
        return dense
    total = sum((F.col(c) for c in classes), F.lit(0))
    return dense.select("label", *[F.try_divide(F.col(c), total).alias(c) for c in classes])


def confidence_by_class(df: DataFrame, prediction: str = "prediction", confidence: str = "confidence") -> DataFrame:
    return df.groupBy(F.col(prediction).alias("class")).agg(
        F.avg(confidence).alias("mean_confidence"),
        F.stddev_pop(confidence).alias("std_confidence"),
        F.min(confidence).alias("min_confidence"),
        F.max(confidence).alias("max_confidence"),
        F.count(F.lit(1)).alias("n"),
    )


def confidence_bands(by_class: DataFrame) -> DataFrame:
    """(band, report_band, classes): chart bands and report bands of the class means."""
    mean = F.col("mean_confidence")
    band = (
        F.when(mean > 0.9, "very high").when(mean > 0.8, "high").when(mean > 0.6, "medium").otherwise("low")
    )
    report = F.when(mean > 0.8, "high").when(mean >= 0.6, "medium").otherwise("low")
    return by_class.groupBy(band.alias("band"), report.alias("report_band")).agg(
        F.count(F.lit(1)).alias("classes")
    )


def performance_ranking(by_class: DataFrame) -> DataFrame:
    """Classes by mean confidence, with the overall mean and the advice on every row."""
    mean = F.col("mean_confidence")
    everything = W.partitionBy()  # over one row per class
    low = F.count_if(mean < 0.6).over(everything)
    high = F.count_if(mean > 0.8).over(everything)
    return by_class.select(
        F.rank().over(W.orderBy(F.desc("mean_confidence"))).alias("rank"),
        "class",
        "mean_confidence",
        "n",
        F.avg(mean).over(everything).alias("overall_mean"),
        F.concat_ws(
            "; ",
            F.when(low > 0, "Collect more samples, review data quality, consider feature engineering"),
            F.when(high > low, "Overall performance looks good"),
        ).alias("advice"),
    )


def hashing_encoder(width: int = 384) -> Pipeline:
    """Fallback encoder: hashed words, idf, unit length."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=TOKEN, gaps=False),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=width),
            IDF(inputCol="tf", outputCol="tfidf"),
            Normalizer(inputCol="tfidf", outputCol="vector"),
        ]
    )


def embed_documents(
    df: DataFrame,
    row_id: str = "doc_id",
    encode: Callable[[list[str]], list[list[float]]] | None = None,
    batch: int = 32,
    width: int = 384,
    max_length: int | None = None,
) -> DataFrame:
    """(id, embedding): one vector per document, of its whole text unless ``max_length`` is given.

    ``encode`` turns a list of texts into vectors and runs in Arrow batches on the executors;
    without it the hashing encoder is fitted and applied.
    """
    texts = df.select(F.col(row_id).alias("id"), truncate_for_embedding(F.col("text"), max_length).alias("text"))
    if encode is None:
        vectors = hashing_encoder(width).fit(texts).transform(texts)
        return vectors.select("id", vector_to_array("vector", "float32").alias("embedding"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = []
            for at in range(0, len(frame), batch):
                vectors += [list(map(float, v)) for v in encode(frame["text"].iloc[at : at + batch].tolist())]
            yield pd.DataFrame({"id": frame["id"], "embedding": vectors})

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInPandas(run, f"id {id_type}, embedding array<float>")
