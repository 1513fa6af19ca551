import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import mixing


def test_raking_equals_brute_force():
    rng = np.random.default_rng(2)
    shape = (4, 3, 2)
    tokens = rng.integers(1, 1000, shape).astype(float)
    targets = [rng.dirichlet(np.ones(n)) for n in shape]
    codes = [g.ravel() for g in np.indices(shape)]
    weight = mixing.raked(tokens.ravel(), codes, targets)
    table = (weight * tokens.ravel()).reshape(shape)
    for axis, target in enumerate(targets):
        other = tuple(a for a in range(3) if a != axis)
        assert np.allclose(table.sum(other) / tokens.sum(), target, atol=1e-8)
    # plain fitting of the table itself
    plain = tokens.copy()
    for _ in range(3000):
        for axis, target in enumerate(targets):
            other = tuple(a for a in range(3) if a != axis)
            plain *= (target * tokens.sum() / plain.sum(other)).reshape([-1 if a == axis else 1 for a in range(3)])
    assert np.allclose(plain, table)


def test_raking_with_empty_values_and_nothing():
    weight = mixing.raked(np.array([10.0, 0.0, 30.0]), [np.array([0, 1, 2])], [np.array([0.25, 0.5, 0.25])])
    assert np.allclose(weight[[0, 2]] * [10, 30], [20, 20])
    assert (mixing.raked(np.zeros(2), [np.array([0, 1])], [np.ones(2)]) == 1).all()


def docs(spark, n=4000):
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).otherwise("hot").alias("source"),
        F.when(F.col("id") % 5 > 0, "en").when(F.col("id") % 2 > 0, "fr").alias("lang"),
        F.array_join(F.transform(F.sequence(F.lit(1), 5 + F.pmod(F.col("id") * 7, F.lit(40))), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(500)).cast("string"))), " ").alias("text"),
        F.lit("clash").alias("weight"),
    )
    return rows.repartition(4)


@pytest.mark.parametrize("targets", [None, {"source": {"hot": 0.2, "s0": 0.5}, "lang": {"en": 0.5, "fr": 0.3, mixing.NONE: 0.2}}])
def test_sampled_tokens_meet_the_targets(spark, targets):
    df = docs(spark)
    out = mixing.mix(df, targets).toPandas()
    assert len(out) == 4000 and out["probability"].between(0, 1).all() and out["probability"].max() == 1
    mixture = mixing.fit(mixing.with_topic(df.drop("weight")), targets)
    out["lang"] = out["lang"].fillna(mixing.NONE)
    for margin in mixing.MARGINS:
        named = out[margin].where(out[margin].isin(mixture.values[margin]), mixing.POOLED)
        want = {v: s for v, s in mixture.targets[margin].items() if v in set(named)}
        scale = sum(want.values())
        expected = (out["tokens"] * out["probability"]).groupby(named).sum()
        drawn = out["tokens"][out["sampled"]].groupby(named[out["sampled"]]).sum()
        for v, s in want.items():
            assert abs(expected[v] / expected.sum() - s / scale) < 1e-6
            share = s / scale  # six deviations of a share among so many documents
            assert abs(drawn.get(v, 0) / drawn.sum() - share) < 6 * (share * (1 - share) / out["sampled"].sum()) ** 0.5 + 1e-9
    again = mixing.mix(df.repartition(7), targets).toPandas().sort_values("doc_id")
    assert again["sampled"].tolist() == out.sort_values("doc_id")["sampled"].tolist()


def test_topics_and_tokens(spark):
    df = spark.createDataFrame([(1, "One two one"), (2, ""), (3, None), (4, "two ONE"), (5, "x " * 200_000)], "doc_id long, text string")
    out = {r.doc_id: r for r in mixing.with_topic(df).collect()}
    assert [out[i].tokens for i in range(1, 6)] == [3, 0, 0, 2, 200_000]
    assert out[2].topic is None and out[3].topic is None and out[1].topic == out[4].topic and out[5].topic.startswith("topic")


def test_many_values_nulls_and_empty(spark):
    rows = [(i, f"word{i} text", f"s{i}" if i % 2 else None, None) for i in range(200)] + [(None, None, None, None), (7, "", "s7", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix(df).collect()
    assert len(out) == 202 and all(r.sampled in (True, False) for r in out)
    assert len(mixing.fit(mixing.with_topic(df)).cells) <= 66 * 3 * 10
    assert mixing.mix(df.filter("false")).collect() == []
