"""Features, calibration and persistence of the text classifiers."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from folioscope.operators import stages, training


def corpus(spark, classes, n=360, noise=0.25, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = classes[i % len(classes)]
        words = rng.choices([f"{label}{k}" for k in range(6)], k=3) + rng.choices([f"w{k}" for k in range(40)], k=8)
        rows.append((i, " ".join(words), label if rng.random() > noise else rng.choice(classes)))
    return spark.createDataFrame([*rows, (n, None, classes[0]), (n + 1, "", classes[1])], "doc_id long, text string, label string")


def test_features_equal_the_feature_table(spark):
    df = corpus(spark, ["aa", "bb", "cc"], 90)
    model = Pipeline(stages=training.text_features(10_000, 2.0, 0.9)).fit(df)
    terms = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    got = {}
    for r in model.transform(df).select("doc_id", "features").collect():
        got |= {(r.doc_id, terms[i]): v for i, v in zip(r.features.indices.tolist(), r.features.values.tolist())}
    want = {(r.id, r.term): r.weight for r in training.tfidf_features(df).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


@pytest.mark.parametrize("folds", [0, 3])
def test_saved_models_score_alike(spark, tmp_path, folds):
    df = corpus(spark, ["aa", "bb", "cc"], 120)
    model = training.train_linear_classifier(df, 200, max_iter=5, calibration_folds=folds)
    model.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    rows = lambda m: sorted((r.doc_id, r.prediction, round(r.confidence, 9)) for r in training.score_batch(m, df).collect())
    assert rows(model) == rows(again) and len(rows(model)) == 122


def log_loss(scored):
    p = F.greatest(F.try_element_at("confidence_scores", F.col("label")), F.lit(1e-12))
    return scored.agg(F.avg(-F.log(p))).first()[0]


def test_calibration_beats_softmax_on_held_out_rows(spark):
    df = corpus(spark, ["aa", "bb", "cc", "dd"], 1600, 0.5).coalesce(2)
    train, test = df.filter("doc_id % 5 > 1"), df.filter("doc_id % 5 < 2")
    plain = training.score_batch(training.train_linear_classifier(train, 300, max_iter=20), test).cache()
    scaled = training.score_batch(training.train_linear_classifier(train, 300, max_iter=20, calibration_folds=3), test).cache()
    assert log_loss(scaled) < 0.95 * log_loss(plain)
    sums = scaled.select(F.aggregate(F.map_values("confidence_scores"), F.lit(0.0), lambda a, v: a + v).alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in sums.collect())


def test_two_classes_get_a_sigmoid(spark):
    df = corpus(spark, ["aa", "bb"], 120)
    model = training.train_linear_classifier(df, 100, max_iter=10)
    margins = {r.doc_id: r.rawPrediction[1] for r in model.transform(df).select("doc_id", "rawPrediction").collect()}
    for r in training.score_batch(model, df).collect():
        p = 1 / (1 + math.exp(-margins[r.doc_id]))
        assert r.confidence_scores["bb"] == pytest.approx(p) and r.confidence_scores["aa"] == pytest.approx(1 - p)


def test_sigmoids_equal_a_plain_newton_fit(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    f = (2 * y - 1) * 0.8 + rng.standard_normal(400)
    df = spark.createDataFrame([(Vectors.dense([-x, x]), float(t)) for x, t in zip(f.tolist(), y.tolist())], ["rawPrediction", "label_index"])
    model = stages.PlattScaling().fit(df)
    n = y.sum()
    t = np.where(y == 1, (n + 1) / (n + 2), 1 / (400 - n + 2))
    a, b = 0.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(a * f + b))
        w, off = p * (1 - p), t - p
        h = np.array([[(w * f * f).sum(), (w * f).sum()], [(w * f).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, [(off * f).sum(), off.sum()])
    assert np.allclose([model.getOrDefault(model.slopes)[1], model.getOrDefault(model.shifts)[1]], [a, b], atol=1e-6)


def test_texts_are_cut_three_times_and_the_fit_is_the_pipelines(spark, monkeypatch):
    df = corpus(spark, ["aa", "bb", "cc"], 120).coalesce(1)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    model = training.train_logistic(df.withColumn("text", seen.asNondeterministic()("text")), 200, max_iter=20)
    # the vocabulary's pass or two, the counts' pass; the weights and the optimiser read stored counts
    assert df.count() <= read.value <= 3 * df.count()
    plain = Pipeline(stages=[training._label_index(), *training.text_features(200, 1.0, None)]).fit(df)
    rows = plain.transform(df)
    want = training.LogisticRegression(labelCol="label_index", family="multinomial", maxIter=20, regParam=1.0 / df.count()).fit(rows)
    assert np.allclose(model.stages[-1].coefficientMatrix.toArray(), want.coefficientMatrix.toArray(), atol=1e-6)


def test_the_best_model_of_a_grid_takes_texts(spark):
    df = corpus(spark, ["aa", "bb"], 90, noise=0.05)
    found = training.grid_search(df, vocabularies=(50,), penalties=(0.01,), folds=2)
    scored = training.score_batch(found.bestModel, df.filter("text is not null"))
    assert scored.filter("prediction = label").count() > 60
