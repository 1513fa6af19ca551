import itertools
import random

import numpy as np
import pytest

from folioscope.llm import toxicity as tox

PLAIN = "the of and river stone walk table green under window paper cloud market garden letter morning".split()
INSULTS = "idiot moron worthless clown".split()


def plain_features(word):
    """Subsequences of three letters with their weights, by definition."""
    marked = [tox.EDGE, *(ord(c) - 96 for c in word), tox.EDGE]
    out = {}
    for i, j, k in itertools.combinations(range(len(marked)), 3):
        if k - i < tox.SPAN and not (i == 0 and k == len(marked) - 1):
            u = (marked[i] * 64 + marked[j]) * 64 + marked[k]
            out[u] = out.get(u, 0) + tox.DECAY ** (k - i + 1)
    return out


@pytest.mark.parametrize("a,b", [("idiot", "idxiot"), ("abc", "abc"), ("worthless", "worth"), ("aaaaaaaa", "aaa"), ("abcdefghijklmnopqrstuvwx", "mnop")])
def test_kernel_equals_its_definition(a, b):
    fa, fb = plain_features(a), plain_features(b)
    want = sum(v * fb.get(u, 0) for u, v in fa.items()) / tox.LENGTH_NORM[len(a)] / tox.LENGTH_NORM[len(b)]
    columns, rows = tox.features([a])
    assert np.isclose(tox.against(columns, rows, [b])[0, 0], want)
    weights = np.zeros(tox.LETTERS**3)
    weights[columns] = rows[0]
    assert np.isclose(tox.weighted(weights, *tox.as_letters([b]))[0], want)


def test_words_of_a_text():
    letters, first, length, (sentence, owner) = tox.words_of(["You id.i.o.t! I d i o t. 1d10t 10 x\nÉté", "", "w" * 60])
    words = tox.as_strings(letters, first, length)
    assert words[:4] == ["you", "idiot", "idiot", "idiot"] and owner.tolist()[:4] == [0] * 4
    assert words[5] == chr(96 + 27 + 0xE9 - 0xDF) + "t" + chr(96 + 27 + 0xE9 - 0xDF)
    assert [len(w) for w, o in zip(words, owner) if o == 2] == [24, 24, 24, 24] and 1 not in owner
    assert sentence[3] > sentence[2] and len(words) == len(first)


def texts(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choices(PLAIN, k=40)
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(INSULTS)
        out.append((i, ". ".join(" ".join(words[a : a + 8]) for a in range(0, 40, 8)), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return tox.train(spark.createDataFrame(texts(), "id long, text string, toxic int").repartition(4))


def test_held_out_accuracy_and_disguises(spark, model):
    rows = texts(200, seed=9)
    df = spark.createDataFrame([(i, t, y, "clash") for i, t, y in rows] + [(900, None, 0, "c"), (901, "", 0, "c"), (None, "?!", 0, None)], "doc_id long, text string, y int, toxicity string")
    out = {r.doc_id: r for r in tox.assess(df, model).collect()}
    assert len(out) == 203 and set(out[0].asDict()) == {"doc_id", "text", "y", "toxicity", "worst_word"}
    assert all((out[i].toxicity >= tox.PREDICT_AT) == bool(y) for i, _, y in rows)
    assert all(0 <= out[i].toxicity < tox.PREDICT_AT and out[i].worst_word is None for i in (900, 901, None))
    for disguise in ("i d i o t", "i.d.i.o.t", "idi0t", "IDIOT!!", "idioot", "mor-on", "worthleess", "cl*own"):
        value, _ = model.decide(["the river and the " + disguise + " of stone"])
        assert model.score(value)[0] >= tox.PREDICT_AT, disguise
    long = "the river and the stone. " * 40_000
    value, worst = model.decide([long, long + "moron"])
    assert model.score(value)[0] < tox.PREDICT_AT <= model.score(value)[1] and worst[1] == "moron"


def test_groups_and_slices_do_not_matter(model, monkeypatch):
    rows = [t for _, t, _ in texts(30, 3)]
    whole = model.decide(rows)[0]
    monkeypatch.setattr("folioscope.llm.langid.CHUNK", 100)
    assert np.allclose(model.decide(rows)[0], whole)
    assert np.allclose(np.concatenate([model.decide([r])[0] for r in rows]), whole)


def test_copied_toxic_texts_do_not_make_their_words_toxic(spark):
    odd = "gnu licence quartz of the river idiot"
    rows = texts() + [(1000 + i, odd, 1) for i in range(60)] + [(2000, "gnu licence quartz and stone", 0)]
    values = tox.word_values(spark.createDataFrame(rows, "id long, text string, toxic int"))
    assert values["quartz"][1] == 1 and values["idiot"][1] > 10 and values["idiot"][0] > tox.TELLING


def test_without_labels(spark):
    df = spark.createDataFrame(texts(8), "id long, text string, toxic int")
    for part in (df.filter("false"), df.filter("toxic = 0")):
        none = tox.train(part)
        assert [r.toxicity for r in tox.assess(df, none).collect()] == [0.0] * 8
    assert tox.assess(df.filter("false"), none).count() == 0


def test_svm_separates_and_calibration_rises():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5))
    y = np.sign(x[:, 0] + 0.2)
    w = tox.fit_svm(x, y, np.ones(200))
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97
    a, b = tox.calibrated(x @ w[:-1] + w[-1], y > 0)
    assert a > 0 and np.isfinite(b)
