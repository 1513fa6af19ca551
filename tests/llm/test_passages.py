"""Passages that no line shows, against all windows of 50 words."""

import random
import re

import pytest

from folioscope.llm import paragraphs, passages


def brute_force(rows, run):
    """The characters of each text that lie in a window that stands at an earlier place and does not overlap it."""
    first, out = {}, {}
    for i, text in sorted(set(r for r in rows if r[0] is not None and r[1])):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in text[a:b]) for a, b in words]
        for k in range(len(words) - run + 1):
            start, end = words[k][0], words[k + run - 1][1]
            doc, _, until = first.setdefault(tuple(low[k : k + run]), (i, start, end))
            if doc != i or start >= until:
                out.setdefault(i, set()).update(range(start, end))
    return out


def corpus(seed):
    rng = random.Random(seed)

    def words(n):
        return [f"w{rng.randrange(3000)}" if rng.random() > 0.05 else "Été" for _ in range(n)]

    shared = [words(n) for n in (50, 59, 75, 130, 200)]
    rows = []
    for i in range(200):
        body = words(rng.randrange(20, 250))
        if i % 4 == 0:
            own = list(rng.choice(shared))
            if i % 8 == 0:
                own[rng.randrange(len(own))] = "edited"
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        every = rng.choice([7, 12, 40, 10_000])  # wrapped at other places, or one long line
        rows.append((900 - i, "\n".join(" ".join(body[k : k + every]) for k in range(0, len(body), every))))
    loop = words(60)
    rows += [(2000, " ".join(words(1) * 300)), (2001, " ".join(loop * 4)), (2002, None), (2003, ""), (None, rows[0][1]), rows[4]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_windows(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(5)
    got = {}
    for r in passages.repeated_windows(paragraphs.keyed(df)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    want = brute_force(rows, passages.RUN)
    assert len(want) > 30 and got == want


def test_passages_in_longer_lines_and_wrapped_go(spark):
    rng = random.Random(9)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    run, own = words(60), [words(60) for _ in range(6)]
    texts = [own[0] + run + own[1], own[2] + run + own[3], own[4] + run + own[5]]
    rows = [(1, " ".join(texts[0])), (2, " ".join(texts[1])), (3, "\n".join(" ".join(texts[2][k : k + 10]) for k in range(0, 180, 10)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    removals = paragraphs.repeats(df)
    out = {r.doc_id: r.text.split() for r in paragraphs.without_repeats(df, removals).collect()}
    assert out == {1: texts[0], 2: own[2] + own[3], 3: own[4] + own[5]}
    assert {(r.doc_id, r.paragraph, r.kept_doc_id, r.kept_paragraph) for r in removals.collect()} == {(2, 0, 1, 0), (3, 6, 1, 0)}


def test_other_text_of_a_doc_id_stays(spark):
    rng = random.Random(3)
    run, more, other = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    df = spark.createDataFrame([(1, run), (2, more + " " + run), (2, other)], "doc_id long, text string")
    out = paragraphs.without_repeats(df, paragraphs.repeats(df, by_text=True)).collect()
    assert sorted(r.text.split() for r in out) == sorted([run.split(), more.split(), other.split()])
