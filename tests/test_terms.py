import itertools
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.operators import terms, training

TEXTS = ["", "a", "aa", "Aa aa AA bb", "été aa\tété_1 x bb", "bb bb bb cc", "aa " * 300 + "bb", None, "cc dd aa bb", "فاتورة رقم"]


def grams(text):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(words) + Counter(map(" ".join, zip(words, words[1:])))


@pytest.mark.parametrize("small", [False, True])
def test_uses_equal_a_plain_count(spark, monkeypatch, small):
    if small:  # every limit is met: terms are handed on several times
        for name, value in (("AT_ONCE", 6), ("HELD", 8), ("WORDS", 3)):
            monkeypatch.setattr(terms, name, value)
    df = spark.createDataFrame([(t, i % 3) for i, t in enumerate(TEXTS * 2)], "text string, fold int").coalesce(2)
    got = terms.term_uses(df, 3).groupBy("term", "fold").agg(F.sum("uses").alias("u"), F.sum("df").alias("d")).collect()
    want = {}
    for i, t in enumerate(TEXTS * 2):
        for g, n in [*grams(t).items(), ("", 0)]:
            u, d = want.get((g, i % 3), (0, 0))
            want[g, i % 3] = (u + n, d + 1)
    assert {(r.term, r.fold): (r.u, r.d) for r in got} == want


def test_counts_of_a_vocabulary():
    vocabulary = ["bb", "aa bb", "aa aa", "été", "not there", "dd aa"]
    batch = pa.RecordBatch.from_arrays([pa.array([(t or "").lower() for t in TEXTS])], ["text"])
    (out,) = terms.counts_of(vocabulary, 0)(iter([batch]))
    got = [dict(zip(v["indices"], v["values"])) for v in out.column(0).to_pylist()]
    want = [{i: grams(t)[v] for i, v in enumerate(vocabulary) if grams(t)[v]} for t in TEXTS]
    assert got == want and all(v["size"] == 6 and v["indices"] == sorted(v["indices"]) for v in out.column(0).to_pylist())


def test_a_grid_is_the_whole_one_and_reads_texts_a_few_times(spark):
    words = {"a": "apple pear plum", "b": "stone brick sand"}
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    df = spark.createDataFrame([(f"{words['ab'[i % 2]]} common word{i % 3}", "ab"[i % 2]) for i in range(48)], "text string, label string").coalesce(1)
    found = training.grid_search(df.withColumn("text", seen.asNondeterministic()("text")), max_iter=1, folds=2)
    settings = {r.setting for r in training.grid_results(df, found).collect()}
    axes = ([0.7, 0.8, 0.9], [3.0, 5.0, 7.0], [0.001, 0.01, 0.1], [5000, 10000, 15000])
    assert settings == {f"maxDF={h}, minDF={l}, regParam={r}, vocabSize={v}" for h, l, r, v in itertools.product(*axes)}
    assert read.value <= 2 * df.count()
    held = found.bestModel.transform(df).filter("label_index = prediction").count()
    assert held == 48 and all(0 <= m <= 1 for m in found.avgMetrics)
