"""Extra columns that carry the operators' own names change nothing."""

import pytest
from pyspark.sql import functions as F

from folioscope.llm import langid, mixing, paragraphs, toxicity
from folioscope.llm.names import free

ROWS = [(i, f"the words of text {i} are here and there", "en" if i % 2 else "fr", f"s{i % 3}") for i in range(30)] + [(None, None, None, None), (31, "", None, "s1"), (3, "the words of text 3 are here and there", "en", "s0")]
CLASHES = ["_text", "_lang", "_source", "_topic", "_gone", "_doc_id", "_text_hash", "heavy", "own", "Weight_", "n", "t"]


def table(spark, extra):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in extra})


def test_free_names():
    assert free(["a", "_B"], "_b") == "_b_" and free([], "x") == "x" and free(["x", "x_"], "x") == "x__"


@pytest.mark.parametrize("apply", [
    lambda d: langid.identify(d, langid.train(d)),
    lambda d: toxicity.assess(d, toxicity.Toxicity()),
    lambda d: mixing.mix(d),
    lambda d: mixing.mix(d, driver_cells=2),
    lambda d: paragraphs.without_repeats(d, d.filter("doc_id < 9").select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(4).cast("long").alias("length"))),
    lambda d: paragraphs.without_repeats(d, d.filter("doc_id < 9").select("doc_id", F.hash("text").alias("text_hash"), F.lit(0).cast("long").alias("start"), F.lit(4).cast("long").alias("length"))),
], ids=["language", "toxicity", "mixture", "mixture as a table", "removals", "removals by text"])
def test_clashing_columns(spark, apply):
    plain, wide = apply(table(spark, [])), apply(table(spark, CLASHES))
    assert set(wide.columns) == set(plain.columns) | set(CLASHES)
    told = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = lambda df: sorted((tuple(map(told, r)) for r in df.select(*plain.columns).collect()), key=str)
    assert rows(wide) == rows(plain)
    assert {r[0] for r in wide.select("_text").collect()} == {"clash"}


def test_given_topics_and_tokens_are_used(spark):
    df = table(spark, []).withColumn("topic", F.when(F.col("doc_id") < 20, "a").otherwise("b")).withColumn("tokens", F.lit(7).cast("long"))
    mixed = mixing.mix(df, {"topic": {"a": 0.5, "b": 0.5}}).toPandas()
    assert set(mixed.topic) == {"a", "b"} and set(mixed.tokens) == {7}
    share = (mixed.tokens * mixed.weight).groupby(mixed.topic).sum()
    assert abs(share["a"] / share.sum() - 0.5) < 1e-6
    only = mixing.mix(df.drop("topic")).toPandas()
    assert set(only.tokens) == {7} and only.topic.dropna().str.startswith("topic").all()
