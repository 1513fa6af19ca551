"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

A table hashes a unit vector x to ``floor((a . x + b) / WIDTH)`` for several Gaussian directions a and offsets b; vectors at a
cosine of the threshold or more fall into one bucket of at least one table but for a small chance. Buckets are
compared in blocks by matrix products, and a pair counts in the first table whose bucket it shares. What leaves a
block is one row per vector (how many others it is linked with there, and one of them), never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.session import kept

THRESHOLD = 0.95
WIDTH = 2.0
#: Vectors that share a bucket by chance, about; more directions are used for more vectors.
BUCKET = 512
MISS = 1e-4
BLOCK = 1024


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection is equal for two points at a distance."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tuned(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """``(tables, directions)``: chance mates come to ``BUCKET``, pairs at the threshold are missed at most at ``miss``."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    directions = max(math.ceil(math.log(max(n, 1) / BUCKET) / -math.log(far)), 2)
    return math.ceil(math.log(miss) / math.log1p(-(near**directions))), directions


def table_keys(unit: np.ndarray, tables: int, directions: int, seed: int) -> np.ndarray:
    """One 32-bit key per vector and table; vectors of another dimension get other directions."""
    rng = np.random.default_rng((seed, unit.shape[1]))
    a = rng.standard_normal((unit.shape[1], tables * directions))
    b = rng.uniform(0, WIDTH, tables * directions)
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), tables, directions)
    key = np.full((len(unit), tables), unit.shape[1], np.uint64)
    for d in range(directions):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cells[:, :, d].astype(np.uint64)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (key >> np.uint64(33)).astype(np.int32)


def rows_of(data: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision; all of one dimension."""
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hashed(vectors: DataFrame, tables: int, directions: int, seed: int) -> DataFrame:
    """``vec_id, vector (bytes), digest, keys``; the last three are null where nothing can be linked."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1).to_pylist()
            data: list[bytes | None] = []
            for values in lists:
                x = None if not values or None in values else np.asarray(values, np.float64)
                data.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            keys: list = [None] * len(data)
            for size in {len(d) for d in data if d}:
                at = [i for i, d in enumerate(data) if d and len(d) == size]
                for i, row in zip(at, table_keys(rows_of([data[i] for i in at]), tables, directions, seed).tolist()):
                    keys[i] = row
            digests = [d and hashlib.blake2b(d, digest_size=16).digest() for d in data]
            yield pa.RecordBatch.from_arrays([ids, pa.array(data, pa.binary()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], ["vec_id", "vector", "digest", "keys"])

    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return vectors.mapInArrow(sign, "vec_id long, vector binary, digest binary, keys array<int>")


def block_links(table: int, ids: np.ndarray, n: np.ndarray, unit: np.ndarray, keys: np.ndarray, low: np.ndarray | None, threshold: float):
    """``(row, partner, links)`` of the pairs of a block that no earlier table has: for each row with a link
    the copies it is linked with in all, and the least row of its component in this block."""
    left = np.arange(len(ids)) if low is None else np.flatnonzero(low)
    right = left if low is None else np.flatnonzero(~low)
    a, b = np.nonzero(unit[left] @ unit[right].T >= threshold)
    a, b = left[a], right[b]
    a, b = (x[(a < b) if low is None else (ids[a] != ids[b])] for x in (a, b))
    new = np.ones(len(a), bool)
    for t in range(table):
        new &= keys[a, t] != keys[b, t]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a[new], n[b[new]])
    np.add.at(links, b[new], n[a[new]])
    root = np.arange(len(ids))
    while True:  # least label over the links of the block, with shortcuts
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
    return some, root[some], links[some]


def compared(dealt: DataFrame, threshold: float) -> DataFrame:
    """``(id, other, links)`` from ``dealt`` (table, key, lo, hi, low, id, n, vector, keys), block by block."""
    streamed = dealt.repartition("table", "key", "lo", "hi").sortWithinPartitions("table", "key", "lo", "hi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: pa.Table) -> pa.RecordBatch | None:
            if rows.num_rows < 2:
                return None
            table, lo, hi = (rows.column(c)[0].as_py() for c in ("table", "lo", "hi"))
            ids, n, low = (rows.column(c).to_numpy() for c in ("id", "n", "low"))
            data = rows.column("vector").to_pylist()
            if len({len(d) for d in data}) > 1:  # two dimensions with one key by chance
                out = [links(rows.filter(pa.array([len(d) == size for d in data]))) for size in {len(d) for d in data}]
                out = [o for o in out if o is not None]
                return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None
            keys = np.asarray(rows.column("keys").combine_chunks().flatten()).reshape(len(ids), -1)
            some, other, many = block_links(table, ids, n, rows_of(data), keys, None if lo == hi else low, threshold)
            if not len(some):
                return None
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[other]), pa.array(many)], ["id", "other", "links"])

        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "key", "lo", "hi")], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for a, b in zip(cuts, cuts[1:]):
                if held and at != tuple(place[a]):
                    if out := links(pa.concat_tables(held)):
                        yield out
                    held = []
                at = tuple(place[a])
                held.append(rows.slice(a, b - a))
        if held and (out := links(pa.concat_tables(held))):
            yield out

    return streamed.mapInArrow(check, "id long, other long, links long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, seed: int = 11) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id, embedding``): ``vec_id, n_links, component_id, kept``.

    Two vectors are linked if their cosine in double precision is ``threshold`` or more; a pair just at the threshold
    is missed with probability ``miss`` at most. ``n_links`` counts the other vectors linked directly, each copy
    of one vector included; ``component_id`` is the least vec_id that can be reached, itself included.

    Equal vectors are one class with a count, so copies cost one row each. Vectors that are null, empty, zero or
    hold null or non-finite numbers, and vectors of different dimension, are linked with nothing. A row without
    vec_id is linked with nothing, has no component and is kept. A vec_id with several vectors gets the results of each.
    Other columns are ignored; an empty table gives no rows. A bucket of any size is cut
    into blocks of at most about ``BLOCK`` classes that are compared pairwise.
    """
    tables, directions = tuned(vectors.count(), threshold, miss)
    signed = kept(hashed(vectors, tables, directions, seed), "vectors")
    usable = signed.filter("digest is not null and vec_id is not null")
    counts = usable.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = kept(counts, "classes")
    firsts = usable.withColumnRenamed("vec_id", "id").join(classes, ["digest", "id"]).dropDuplicates(["id", "digest"])
    nodes = kept(firsts.select("id", "n", "vector", "keys"), "nodes")
    buckets = nodes.select("id", F.posexplode("keys").alias("table", "key"))
    sizes = buckets.groupBy("table", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = (
        nodes.select("*", F.posexplode("keys").alias("table", "key"))
        .join(sizes, ["table", "key"])
        .withColumn("own", F.pmod(F.xxhash64("id"), blocks))
        .withColumn("next", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .withColumn("lo", F.least("own", "next"))
        .withColumn("hi", F.greatest("own", "next"))
        .select("table", "key", "lo", "hi", (F.col("own") == F.col("lo")).alias("low"), "id", "n", "vector", "keys")
    )
    found = kept(compared(dealt, threshold), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.filter("id != other"), "id", "other")
    known = classes.join(links, "id", "left").join(labels, "id", "left")
    known = known.select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = signed.select("vec_id", "digest").join(known, "digest", "left")
    has_id = F.col("vec_id").isNotNull()
    component = F.when(has_id, F.coalesce("component", "vec_id"))
    n_links = F.when(has_id, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
