import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import shingles, sketches
from folioscope.llm.components import components


def plain_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def plain_set(text, n=5):
    words = plain_words(text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbBéÉ \t\n\x0b\x1c \x85", max_size=40)), max_size=12))
def test_words_and_sets_equal_the_plain_definition(texts):
    ids = {}
    for text, words in zip(texts, shingles.text_words(texts), strict=True):
        plain = plain_words(text)
        assert len(plain) == len(words)
        for w, h in zip(plain, words.tolist()):
            assert ids.setdefault(h, w) == w and len(set(ids.values())) == len(ids)
        assert len(shingles.shingle_set(words)) == len(plain_set(text))


def test_slices_end_between_words(monkeypatch):
    text = ("alpha beta " * 50 + "x" * 100 + " gamma\n" * 20).encode()
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "SLICE", 16)
    assert all((a == b).all() for a, b in zip(whole, shingles.word_hashes(text)))
    texts = ["one two three", None, "", "four " * 30, "five"]
    assert [len(w) for w in shingles.text_words(texts)] == [3, 0, 0, 30, 1]


def test_digests_tell_sequences_and_sets_apart():
    a, b, c = (next(shingles.text_words([t])) for t in ("one two three", "two one three", "One two  three\n"))
    assert shingles.digest(a) == shingles.digest(c) != shingles.digest(b)
    assert shingles.digest(a[:0]) == shingles.digest(b[:0])
    assert shingles.set_digest(np.sort(a)) == shingles.set_digest(np.sort(b)) != shingles.set_digest(np.sort(a)[:2])


def test_every_coordinate_fills_and_agreement_estimates_jaccard():
    rng = np.random.default_rng(5)
    for shared, own in ((800, 100), (40, 5), (5, 2), (1, 0), (3000, 3000)):
        gaps = []
        for seed in range(25):
            x = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
            got = sketches.sketch([x[: shared + own], np.concatenate([x[:shared], x[shared + own :]])], 64, seed)
            assert (got != sketches.EMPTY).all()
            gaps.append((got[0] == got[1]).mean() - shared / (shared + 2 * own))
        assert abs(np.mean(gaps)) < 0.05 and np.abs(gaps).max() < 0.3
    empty = sketches.sketch([np.zeros(0, np.uint64), x], 64)
    assert (empty[0] == sketches.EMPTY).all() and (empty[1] != sketches.EMPTY).all()


def test_sketch_does_not_hang_on_order_or_company():
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 3, 50, 2000)]
    together = sketches.sketch(sets, 40)
    for s, row in zip(sets, together):
        assert (sketches.sketch([rng.permutation(s)], 40)[0] == row).all()
    assert len(np.unique(sketches.band_keys(together, 4))) == 40


def test_tuned_bands():
    bands, rows = sketches.tuned_bands(0.8, 1e-5, 256)
    assert bands * rows <= 256 and (1 - 0.8**rows) ** bands <= 1e-5
    assert sketches.tuned_bands(0.1, 1e-9, 4) == (4, 1)


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(1, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)] + [(500, 400), (400, 600), (600, 500)], [(5, 9), (9, 5), (9, 7), (2, 7), (20, 21)]])
def test_components(spark, edges):
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=30), max_size=12), st.integers(1, 6))
def test_sets_hashed_together_equal_single_ones(sequences, n):
    words = [shingles.mixed(np.array(s, np.uint64)) for s in sequences]
    sets, digests = shingles.shingle_sets(words, n)
    assert len(sets) == len(digests) == len(words)
    for w, found, digest in zip(words, sets, digests):
        alone = shingles.shingle_set(w, n)
        assert found.tolist() == alone.tolist() and digest == shingles.set_digest(alone)
