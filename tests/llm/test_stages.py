"""Single stages on rows that test_pipeline's table does not have."""

import random

import corpus_pipeline
from test_neardup import brute_force as group


def similar_pairs(seed):
    """Pairs of texts whose similarity lies between 0.8 and 0.85, and unlike ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        rows.append((2 * i, " ".join(words)))
        changed = list(words)
        for k in (20, 60, 100, 140)[: 4 if i % 2 else 2]:  # 180 of 220, or 190 of 210 shingles
            changed[k] = "x"
        rows.append((2 * i + 1, " ".join(changed)))
    return rows


def test_near_duplicates_are_linked_at_four_fifths(spark):
    rows = similar_pairs(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, _, _, stays in group(rows, 80) if stays}
    assert len(want) == 40 < len([1 for r in group(rows, 85) if r[3]])
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()} == want


def test_near_duplicates_are_dropped_row_by_row(spark):
    """Rows that repeat each other leave one, and a clean text under a copy's doc_id stays."""
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, clean, other = text(), text(), text(), text()
    near = a.replace(a.split()[30], "x")
    rows = [(5, a), (5, a), (7, near), (7, clean), (2, b), (9, b), (9, other), (None, a), (4, None), (4, None), (6, ""), (3, clean + " y")]
    df = spark.createDataFrame([(i, t, k, "clash") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row int, _least string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()), key=str)
    want = [(5, a), (3, clean + " y"), (2, b), (9, other), (None, a), (4, None), (4, None), (6, "")]
    assert got == sorted(want, key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, df.filter("false"), "").collect() == []
