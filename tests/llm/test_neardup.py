import random
from collections import defaultdict

import pytest

from folioscope.llm import linking
from folioscope.llm.neardup import near_duplicates
from test_sketches import plain_set


def brute_force(rows, percent):
    """Sizes and least reachable doc_id, over all pairs."""
    sets = [plain_set(t) for _, t in rows]
    label = {i: i for i, _ in rows if i is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    holders = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        common = defaultdict(int)
        for s in sets[k]:
            for other in holders[s]:
                common[other] += 1
            holders[s].append(k)
        for other, n in common.items():
            j = rows[other][0]
            if i is not None and j is not None and 100 * n >= percent * (len(sets[k]) + len(sets[other]) - n):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)), key=str)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
    return text


def corpus(seed):
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(120)]
    base = words(rng, 200)
    texts += [" ".join(base)] * 40  # copies
    texts += [" ".join(edited(rng, base, rng.choice([1, 2, 3, 3, 4]))) for _ in range(150)]  # near copies, many linked by the base alone
    passage = words(rng, 150)
    texts += [" ".join(words(rng, 12) + passage + words(rng, rng.randrange(5, 60))) for _ in range(120)]  # alike, seldom enough
    chain = words(rng, 150)
    for _ in range(25):
        chain = edited(rng, chain, 1)
        texts.append(" ".join(chain))
    texts += ["One two", "one TWO", "one two ", "", " \n", None, "a b c d", "a b c d", "é à ü ö ß", "É à ü ö ß"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80)])
def test_equals_brute_force(spark, monkeypatch, seed, percent):
    monkeypatch.setattr(linking, "GROUP", 7)
    monkeypatch.setattr(linking, "BLOCK", 9)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, kept string, component long").repartition(5)
    got = sorted((tuple(r) for r in near_duplicates(df, percent).collect()), key=str)
    assert got == brute_force(rows, percent)


def test_repeated_rows_null_ids_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "same text of a few words"), (5, "same text of a few words"), (9, "same text of a few words"), (5, "x y z x y z x"), (4, "x y z x y z x"),
            (None, "same text of a few words"), (None, None), (2, long), (3, long + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert [g[:2] for g in got] == sorted(((i, len(plain_set(t))) for i, t in rows), key=str)
    component = {(g[0], g[1]): g[2:] for g in got}
    assert component[(9, 2)] == (4, False) and component[(5, 3)] == (4, False) and component[(4, 3)] == (4, True)
    assert component[(None, 2)] == (None, True) and component[(3, 29997)] == (2, False)
    assert near_duplicates(df.filter("false")).collect() == []
