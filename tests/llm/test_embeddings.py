import math

import numpy as np
import pytest

from folioscope.llm import embeddings


def brute_force(rows, threshold=0.95):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and None not in v and all(math.isfinite(x) for x in v) and any(v):
            x = np.asarray(v, float) / max(map(abs, v))
            good[k] = x / np.linalg.norm(x)
    label, links = {k: rows[k][0] for k in range(len(rows))}, dict.fromkeys(range(len(rows)), 0)
    pairs = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return sorted(((i, links[k], label[k], i is None or label[k] == i) for k, (i, _) in enumerate(rows)), key=str)


def table(seed, n=500, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    hot = x[0] / np.linalg.norm(x[0])
    near = [hot + rng.standard_normal(dim) * rng.choice([0.02, 0.045, 0.06]) for _ in range(200)]
    chain = [x[1] / np.linalg.norm(x[1])]
    for _ in range(20):
        chain.append(chain[-1] + rng.standard_normal(dim) * 0.05)
    vectors = [*x, *near, *chain, *[x[2]] * 80, x[3] * 1e200, x[3] * 3, x[3] * 1e-200]
    order = rng.permutation(len(vectors))
    return [(int(k) * 2 + 1, np.asarray(vectors[v], float).tolist()) for k, v in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(embeddings, "BUCKET", 40)  # several directions
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    rows = table(seed)
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], "vec_id long, embedding array<double>, n int, digest string").repartition(4)
    got = sorted((tuple(r) for r in embeddings.near_duplicate_vectors(df).collect()), key=str)
    want = brute_force(rows)
    assert len(got) == len(want)
    links = sum(w[1] for w in want)
    found = sum(g[1] for g in got)
    assert 0.999 * links <= found <= links and all(g[1] <= w[1] for g, w in zip(got, want))
    assert got == want


def test_bad_vectors_ties_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]),
            (9, [2.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None), (10, [-1.0, 0.0]), (11, [5.0]), (12, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embeddings.near_duplicate_vectors(df).collect()), key=str)
    assert got == brute_force(rows)
    assert embeddings.near_duplicate_vectors(df.filter("false")).collect() == []


def test_collision_chance_and_tuning():
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 40_000, 2)), rng.uniform(0, embeddings.WIDTH, 40_000)
    x, y = np.array([1.0, 0.0]), np.array([math.cos(0.7), math.sin(0.7)])
    cell = [np.floor((a[0] @ v + b) / embeddings.WIDTH) for v in (x, y)]
    assert abs((cell[0] == cell[1]).mean() - embeddings.collision(float(np.linalg.norm(x - y)))) < 0.01
    tables, directions = embeddings.tuned(10**9)
    near = embeddings.collision(math.sqrt(0.1))
    assert (1 - near**directions) ** tables <= embeddings.MISS and directions > embeddings.tuned(10**4)[1]
