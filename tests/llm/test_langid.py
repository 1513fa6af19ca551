import math
import random

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import langid

EN = "the cat and the dog went to the house with them".split()
FR = "le chat et la chienne sont allés à l'école avec eux".split()


def bucket_of(gram):
    key = 0
    for n, c in enumerate(gram, 1):
        key = (key * 0x9E3779B97F4A7C15 + ord(c) + n) % 2**64
    key = ((key ^ (key >> 29)) * 0xBF58476D1CE4E5B9) % 2**64
    return key >> (64 - langid.BITS)


def plain_counts(text):
    """Letters in lower case, all else as single blanks; n-grams that do not begin and end blank."""
    clean = "".join(c.lower() if c.isalpha() else " " for c in text)
    while "  " in clean:
        clean = clean.replace("  ", " ")
    clean += "" if clean.endswith(" ") else " "
    found = {}
    for n in langid.SIZES:
        for i in range(len(clean) - n + 1):
            g = clean[i : i + n]
            assert len(g) == n
            if g[0] != " " or g[-1] != " ":
                found[bucket_of(g)] = found.get(bucket_of(g), 0) + 1
    return found


def rows(n=400):
    rng = random.Random(1)
    return [(i, " ".join(rng.choices(EN if i % 3 else FR, k=12)), "en" if i % 3 else "fr") for i in range(n)]


def test_counts_equal_the_plain_definition(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 64)
    texts = ["", None, "a", "Été 2024, ok!", "x" * 500, "--", "The cat. " * 40, "日本語 text"]
    got = [{} for _ in texts]
    for group, bucket, which in langid.text_counts(texts):
        for b, w in zip(bucket.tolist(), which.tolist()):
            got[group[w]][b] = got[group[w]].get(b, 0) + 1
    assert got == [plain_counts(t or "") for t in texts]


def test_model_and_scores_equal_brute_force(spark):
    data = rows()
    model = langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4))
    totals = {"en": np.zeros(1 << langid.BITS), "fr": np.zeros(1 << langid.BITS)}
    for _, text, lang in data:
        for b, n in plain_counts(text).items():
            totals[lang][b] += n
    assert model.names == ["en", "fr"]
    share = {k: (sum(r[2] == k for r in data) + 1) / (len(data) + 2) for k in totals}
    texts = ["the dog", "la chienne", "cat", "allés à l'école " * 30]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores):
        counts = plain_counts(text)
        n = sum(counts.values())
        logs = {}
        for k, t in totals.items():
            each = sum(c * math.log((t[b] + 0.5) / (t.sum() + 0.5 * len(t))) for b, c in counts.items())
            logs[k] = each / math.sqrt(max(n / langid.FULL_EVIDENCE, 1)) + math.log(share[k])
        top = max(logs.values())
        want = 1 / sum(math.exp(v - top) for v in logs.values())
        assert logs[name] == top and abs(score - want) < 1e-3
    assert names == ["en", "fr", "en", "fr"]


def test_held_out_accuracy_nulls_and_clashes(spark):
    data = [(*r, "clash") for r in rows()] + [(1000, None, None, "c"), (1001, "42 !!", "en", "c"), (None, "the cat", None, None), (7, "le chat", "fr", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(df.filter(~langid.held_out()))
    out = langid.identify(df, model).withColumn("held", langid.held_out()).collect()
    assert len(out) == len(data)
    held = [r for r in out if r.held and r.doc_id < 1000]
    assert len(held) > 50 and all(r.lang_pred == r.lang and 0.5 <= r.lang_score <= 1 for r in held)
    other = {r.doc_id: (r.lang_pred, r.lang_score) for r in out if r.doc_id is None or r.doc_id >= 1000}
    assert other[1000] == ("und", 0.0) and other[1001] == ("und", 0.0) and other[None][0] == "en"


def test_bounded_sample_and_empty(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = langid.train(df, most_rows=60)
    assert model.predict(["the dog with them", "la chienne avec eux"])[0] == ["en", "fr"]
    nothing = langid.train(df.filter("false"))
    assert [tuple(r) for r in langid.identify(df.filter("doc_id = 1"), nothing).select("lang_pred", "lang_score").collect()] == [("und", 0.0)]
    assert langid.identify(df.filter("false"), model).count() == 0
    one = langid.train(df.withColumn("lang", F.lit("xx")))
    assert one.predict(["abc", "", None]) [0] == ["xx", "und", "und"]
