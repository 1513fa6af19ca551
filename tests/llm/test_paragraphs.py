import random
from collections import defaultdict

import pytest

from folioscope.llm import paragraphs
from test_sketches import plain_set, plain_words


def brute_force(rows, percent, min_words):
    found = sorted({(i, k, line) for i, text in rows if i is not None for k, line in enumerate((text or "").split("\n")) if len(plain_words(line)) >= min_words})
    sets = [plain_set(line) for _, _, line in found]
    label = list(range(len(found)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for other in holders[x]:
                common[other] += 1
            holders[x].append(k)
        for other, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = find(k), find(other)
                label[max(a, b)] = min(a, b)
    out = []
    for k, (i, place, line) in enumerate(found):
        root = found[find(k)]
        if find(k) != k:
            start = sum(len(x) + 1 for x in next(t for j, t in rows if j == i and (t or "").split("\n")[place : place + 1] == [line]).split("\n")[:place])
            out.append((i, place, start, len(line), root[0], root[1]))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)

    def line(n):
        return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))

    passages = [line(60) for _ in range(6)]
    boiler = line(30)
    rows = []
    for i in range(160):
        lines = [line(rng.randrange(1, 70)) for _ in range(rng.randrange(0, 5))]
        if i % 3 == 0:
            words = rng.choice(passages).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                words[rng.randrange(60)] = "é"
            lines.insert(rng.randrange(len(lines) + 1), " ".join(words))
        if i % 2 == 0:
            lines.append(boiler)
        rows.append((1000 - i, "\n".join(lines)))
    same = line(40)
    rows += [(2000, same + "\n\n" + same), (2001, None), (2002, ""), (None, boiler), (2003, "short line\n" + "x" * 500)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], "doc_id long, text string, place int, digest string").repartition(5)
    got = sorted(tuple(r) for r in paragraphs.repeated_paragraphs(df, miss=1e-6, coordinates=240).collect())
    assert got == brute_force(rows, paragraphs.PERCENT, paragraphs.MIN_WORDS)
    texts = {i: t for i, t in rows}
    for doc, place, start, length, _, _ in got:
        assert texts[doc].split("\n")[place] == texts[doc][start : start + length]


def test_texts_without_repeats(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows] + [(3000, corpus(3)[-5][1].split("\n")[0], 1, None)], "doc_id long, text string, n_chars int, lang string")
    removals = paragraphs.repeated_paragraphs(df)
    gone = defaultdict(set)
    for r in removals.collect():
        gone[r.doc_id].add(r.paragraph)
    out = {r.doc_id: r for r in paragraphs.without_repeats(df, removals).collect()}
    assert 3000 not in out and out[2001].text is None and out[2002].text == ""
    for i, t in rows:
        if gone[i]:
            want = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
            assert out[i].text == want and out[i].n_chars == len(want) if want.strip() else i not in out
        else:
            assert out[i].text == t and out[i].n_chars == 7


def test_repeated_rows_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text)], "doc_id long, text string")
    assert [tuple(r) for r in paragraphs.repeated_paragraphs(df).collect()] == [(2, 0, 0, len(text), 1, 0)]
    assert paragraphs.repeated_paragraphs(df.filter("false")).collect() == []
