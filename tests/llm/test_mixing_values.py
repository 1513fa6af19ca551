"""Margins with more values than are raked on the driver or were once named."""

import pytest

from folioscope.llm import mixing


def many(spark):
    rows = [(i, "word " * (5 + i % 7) + f"w{i * 7919 % 1013} v{i * 31 % 977} u{i}", f"s{i % 100:03}", ("en", "fr", None)[i // 100 % 3]) for i in range(4000)]
    rows += [(5000 + i, f"one two w{i} v{i * 37}", "hot", ("en", "fr", None)[i % 3]) for i in range(900)] + [(9000, None, "s000", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)


def test_every_source_has_its_own_goal(spark):
    out = mixing.mix(many(spark)).toPandas()
    expected = (out["tokens"] * out["probability"]).groupby(out["source"]).sum()
    want = out["tokens"].groupby(out["source"]).sum() ** 0.5
    assert len(want) == 101 and abs(expected / expected.sum() - want / want.sum()).max() < 1e-6


def test_every_named_target_holds(spark):
    targets = {"source": {f"s{i:03}": 1.0 + i % 2 for i in range(100)} | {mixing.POOLED: 50.0}}
    out = mixing.mix(many(spark), targets).toPandas()
    expected = (out["tokens"] * out["probability"]).groupby(out["source"]).sum()
    share = expected / expected.sum() * 200
    assert all(abs(share[k] - v) < 1e-4 for k, v in targets["source"].items() if k != mixing.POOLED) and abs(share["hot"] - 50) < 1e-4


@pytest.mark.parametrize("targets", [None, {"source": {"hot": 0.3, "s001": 0.1, mixing.POOLED: 0.6}}])
def test_table_equals_driver(spark, targets):
    df = many(spark).filter("doc_id % 100 < 20 or doc_id >= 5000")
    plain, table = (mixing.mix(df, targets, driver_cells=n).toPandas().sort_values("doc_id") for n in (10**6, 3))
    assert len(plain) == len(table) == df.count()
    assert abs(plain["probability"].to_numpy() - table["probability"].to_numpy()).max() < 1e-6
