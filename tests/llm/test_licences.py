import math
import random
import re

import duckdb
import pytest

from folioscope.llm import licences, queries, statements

FILLER = "the of software license a version 2 under mit apache by cc nc copy wörter 日本 grün public general".split()


def words(text):
    return re.findall(licences.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(own, phrase):
    n = len(phrase)
    return [k for k in range(len(own) - n + 1) if own[k : k + n] == phrase]


def brute_force(texts):
    """Per text ``(n_words, phrases, templates)`` by comparing every phrase with every place."""
    owns = [words(t) for t in texts]
    idf = lambda w: math.log((len(texts) + 1) / (sum(w in o for o in map(set, owns)) + 1)) + 1
    weights = {w: idf(w) for t in licences.TEMPLATES for w in words(t.text)}
    out = []
    for own in owns:
        plain = {(label, k) for label, phrase in licences.PHRASES for k in places(own, words(phrase))}
        seen = set()
        for t in licences.TEMPLATES:
            body = words(t.text)
            room = max(8, len(body) // 4)
            begins = []
            for key in t.keys:
                at = places(body, words(key))[0]
                begins.append({(k - at) // room - back for k in places(own, words(key)) for back in (0, 1)})
            for b in set.intersection(*begins):
                first, end = max(b * room, 0), min(b * room + 2 * room + len(body), len(own))
                share = sum(weights[w] for w in set(body) & set(own[first:end])) / sum(weights[w] for w in set(body))
                if share >= licences.LEAST_SHARE:
                    seen.add((t.label, first, end, round(min(share, 1.0), 9)))
        out.append((len(own), plain, seen))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", "...", "MIT", "Under the MIT License under the mit-license, CC BY-NC 4.0"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            pick = rng.random()
            if pick < 0.4:
                parts.append(" ".join(rng.choices(FILLER, k=rng.randrange(1, 40))))
            elif pick < 0.6:
                parts.append(rng.choice(licences.PHRASES)[1].title())
            else:
                t = rng.choice(licences.TEMPLATES).text.split()
                for _ in range(rng.randrange(0, 3)):  # words changed, put in or left out
                    k = rng.randrange(len(t))
                    t[k : k + rng.randrange(2)] = rng.choices(FILLER, k=rng.randrange(3))
                parts.append(" ".join(t))
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, words string, places int").repartition(3)
    want = brute_force(texts)
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert len(got) == len(texts)
    for k, (n, plain, seen) in enumerate(want):
        r = got[k]
        assert r.n_words == n and {tuple(p) for p in r.phrases} == plain and len(r.phrases) == len(plain)
        assert {(w.label, w.first, w.end, round(w.share, 9)) for w in r.templates} == seen
    assert sum(len(seen) for _, _, seen in want) > 20


def test_query_equals_its_sql(spark, tmp_path):
    texts = corpus(3)
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "x under the MIT License"), (3, "x under the MIT License"), (None, "cc by nc")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_licences(spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(statements.STATEMENTS["op11_licences"])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want.select(*names).fetchall(), key=str)


def test_key_phrases_lie_in_their_templates():
    for key in licences.keys_of(licences.PHRASES, licences.TEMPLATES):
        assert key.template < 0 or words(licences.TEMPLATES[key.template].text)[key.offset :][: len(key.words)] == key.words


def test_very_long_text_and_empty_table(spark):
    text = "word " * 200_000 + "under the MIT License " * 500 + licences.TEMPLATES[0].text
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = licences.scan(df).collect()
    assert r.n_words == len(words(text)) and len(r.phrases) == 500 and r.phrases[0].word == 200_000
    assert {w.label for w in r.templates} == {"mit"}
    assert licences.scan(df.filter("false")).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").filter("doc_id > 0")
    plan = licences.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "MapInArrow", "Exchange"))
