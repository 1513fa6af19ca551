import math
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.operators import quality, training


@pytest.fixture(scope="module")
def texts(spark):
    words = {"a": "apple pear plum", "b": "stone brick sand", "c": "river lake sea"}
    data = [(i, f"{words['abc'[i % 3]]} common word{i % 5}", "abc"[i % 3]) for i in range(60)]
    return spark.createDataFrame(data, "doc_id long, text string, label string").cache()


def shuffled(df, column):
    """Whether an exchange of the plan moves the column."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", part.strip())]
    return any(f"{column}#" in part for part in moved)


def test_tfidf_against_a_plain_count(spark):
    docs = {1: "b a a", 2: "aa bb aa", 3: "aa cc dd"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r.id, r.term): r.weight for r in training.tfidf_features(df, min_df=1, max_df=1.0).collect()}
    idf = lambda n: math.log(4 / (n + 1)) + 1
    raw = {"aa": (1 + math.log(2)) * idf(2), "bb": idf(1), "aa bb": idf(1), "bb aa": idf(1)}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert all(abs(got[(2, t)] - v / norm) < 1e-9 for t, v in raw.items())
    assert (1, "aa") not in got
    limited = training.tfidf_features(df, min_df=1, max_df=1.0, max_features=1)
    assert {r.term for r in limited.collect()} == {"aa"}


def test_no_text_is_shuffled_for_weights(spark, tmp_path):
    spark.createDataFrame([(1, "aa bb")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    assert not shuffled(training.tfidf_features(df), "text")
    assert not shuffled(quality.neighbour_similarity(df), "text")
    assert shuffled(df.repartition("doc_id"), "text")


def test_terms_are_counted_in_the_row(spark):
    rows = [(1, ["b", "a", "b", "é"]), (2, []), (3, None), (4, ["x"] * 5000)]
    df = spark.createDataFrame(rows, "id long, terms array<string>").select("id", training.term_counts(F.col("terms")).alias("c"))
    got = {r.id: r.c and [tuple(x) for x in r.c] for r in df.collect()}
    assert got == {1: [("a", 1), ("b", 2), ("é", 1)], 2: None, 3: None, 4: [("x", 5000)]}


def test_weights_are_balanced(texts):
    weights = training.class_weights(texts.filter("doc_id < 30 or label = 'a'")).collect()
    assert abs(sum(r.n * r.weight for r in weights) - sum(r.n for r in weights)) < 1e-9


def test_models_learn_and_score(texts):
    for fit in (lambda d: training.train_logistic(d, 200, 20), lambda d: training.train_linear_classifier(d, 200, max_iter=10)):
        scored = training.score_batch(fit(texts), texts).cache()
        assert scored.filter("prediction = label").count() >= 57
        sums = scored.select(F.aggregate(F.map_values("confidence_scores"), F.lit(0.0), lambda a, v: a + v).alias("s"))
        assert all(abs(r.s - 1) < 1e-6 for r in sums.collect())


def test_grid_search(texts):
    model = training.grid_search(texts, vocabularies=(50,), penalties=(0.01, 0.1), folds=2)
    assert training.grid_results(texts, model).filter("accuracy > 0.8").count() >= 1


def test_report_and_matrix(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "x")], "label string, prediction string")
    report = {r["class"]: r for r in training.classification_report(df).collect()}
    assert (report["b"].precision, report["b"].recall, report["a"].recall, report["x"].support) == (0.5, 1.0, 0.5, 0)
    assert report["a"].accuracy == 0.5
    matrix = {r.label: (r.a, r.b) for r in training.confusion_matrix(df, ["a", "b"]).collect()}
    assert matrix == {"a": (1, 1), "b": (0, 1)}
    shares = {r.label: r.a for r in training.confusion_matrix(df, ["a", "b", "z"], normalize=True).collect()}
    assert shares == {"a": 0.5, "b": 0.0, "z": None}


def test_confidence_bands(spark):
    df = spark.createDataFrame([("a", 0.95, 3), ("b", 0.85, 2), ("c", 0.6, 1), ("d", 0.3, 1)], "class string, mean_confidence double, n int")
    bands = {r.band: (r.report_band, r.classes) for r in training.confidence_bands(df).collect()}
    assert bands == {"very high": ("high", 1), "high": ("high", 1), "low": ("medium", 1)} or bands["very high"] == ("high", 1)
    ranking = training.performance_ranking(df).orderBy("rank").collect()
    assert [r["class"] for r in ranking] == ["a", "b", "c", "d"] and abs(ranking[0].overall_mean - 0.675) < 1e-9


def test_embeddings(texts):
    vectors = training.embed_documents(texts, width=16).collect()
    assert len(vectors) == 60 and all(len(v.embedding) == 16 for v in vectors)

    def encode(batch):
        return [[float(len(t)), 1.0] for t in batch]

    got = {r.id: list(r.embedding) for r in training.embed_documents(texts, encode=encode, batch=7).collect()}
    want = {r.doc_id: [float(len(r.text)), 1.0] for r in texts.collect()}
    assert got == want


def test_softmax(apply):
    (got,) = apply(training.softmax, [([1.0, 2.0, 1000.0],)], "v array<double>")
    assert got[2] == 1.0 and sum(got) == pytest.approx(1.0)


def test_classified_documents_follow_model_and_rules(spark):
    kinds = {"invoice": "Invoice number {} total due net", "receipt": "Receipt {} thank you cash paid", "contract": "Agreement between the parties {} clause"}
    data = [(i, list(kinds.values())[i % 3].format(i), list(kinds)[i % 3]) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, label string")
    model = training.train_logistic(df, 200, 20)
    odd = spark.createDataFrame([(100, None, None), (101, "", "never seen"), (102, "Invoice number 7 total due net", None)], df.schema)
    # columns named as results are replaced
    rows = training.classify_documents(model, df.unionByName(odd).withColumn("prediction", F.lit("x")).withColumn("rule", F.lit(1))).collect()
    assert sorted(r.doc_id for r in rows) == sorted([*range(60), 100, 101, 102])
    by_id = {r.doc_id: r for r in rows}
    assert by_id[101].label == "never seen" and by_id[102].label is None and by_id[102].model_prediction == "invoice"
    assert sum(r.model_prediction == r.label for r in rows) >= 57
    for r in rows:
        assert abs(sum(r.confidence_scores.values()) - 1) < 1e-6
        sure = r.confidence >= 0.7 and r.prediction != lx.UNKNOWN_TYPE
        assert r.hybrid.confidence_flag == ("ok" if sure else "needs_review")
        assert r.hybrid.final_prediction == (r.prediction if sure else r.rule_by_score or r.prediction)
        assert r.decision.document_type == (r.hybrid.final_prediction if sure else r.rule)
        if r.rule != lx.UNKNOWN_TYPE:
            assert r.final_prediction == r.rule


@pytest.mark.parametrize("stopwords", [(), ("aa", "été")])
def test_terms_of_batches_equal_those_of_single_expressions(spark, stopwords):
    texts = [None, "", "a", "aa", "Aa aa AA bb", "été aa\tété_1 ٣٤ x فاتورة رقم", "K ſſ ß \x1c 𝔘𝔘 ½½ 中文", "aa " * 5000 + "bb"]
    df = spark.createDataFrame(list(enumerate(texts * 3)), "id long, text string").repartition(2)
    rows = df.select("id", F.lower("text").alias("text")).mapInArrow(training.count_terms(stopwords, most=7), "id long, term string, tf bigint")
    want = df.select("id", F.inline(training.term_counts(training.grams(F.col("text"), stopwords))))
    assert rows.count() == want.count() and rows.exceptAll(want).isEmpty()


def test_the_vocabulary_is_counted_once(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa cc aa"), (2, "aa"), (None, "aa cc")], "doc_id long, text string")
    weights = training.tfidf_features(df, min_df=1, max_df=1.0)
    plan = weights._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("mapinarrow") == 1
    assert weights.filter("term = 'aa'").count() == 4
