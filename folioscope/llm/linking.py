"""Similarity links between sets of word shingles: banded sketches, then exact verification.

What must hold at any size and with any hot group:

* Buckets of equal band keys are never expanded into pairs. In each bucket one member is the pivot, the one whose
  buckets are the largest in sum (the text that most others resemble), and all others are verified against it.
  Verified links are contracted to components; buckets that lie in one component are done.
* Where a bucket still spans several components, its members are compared in blocks of at most ``BLOCK``
  rows. Pairs of different components whose sizes allow it are verified on the full sets inside the block;
  what leaves a block is one link per merger, never its pairs. So no link between components is lost
  but those that the bands miss by chance (see ``tuned_bands``).
* Only texts that share a bucket with another are read again, in one shuffle of the table that is the same plan
  at every size. A pivot with very many members is copied to one group per ``GROUP`` members, and
  groups are streamed in sorted order, so no task holds more than one pivot or one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.shingles import shingle_set, text_words
from folioscope.llm.sketches import band_keys, sketch
from folioscope.llm.workers import tidy
from folioscope.session import discard, kept

GROUP = 500
BLOCK = 512
PART = 256  # texts hashed together


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= ``percent`` * union holds for two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def band_column(sets: list[np.ndarray], bands: int, rows: int) -> pa.Array:
    """The band keys of sets, a list per set."""
    keys = band_keys(sketch(sets, bands * rows), rows).view(np.int64).reshape(-1)
    return pa.ListArray.from_arrays(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32), pa.array(keys))


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def verified(edges: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of ``edges`` whose texts (``id, text``) are similar by their full sets."""
    degrees = edges.groupBy("b").agg(F.count(F.lit(1)).alias("d")).withColumn("salts", F.floor(F.col("d") / GROUP) + 1)
    salt = F.pmod(F.xxhash64("a"), F.col("salts"))
    members = edges.join(degrees, "b").select(F.col("a").alias("id"), F.col("b").alias("pivot"), salt.alias("salt"), F.lit(1).alias("member"))
    pivots = degrees.select(F.col("b").alias("id"), F.col("b").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    requests = kept(members.unionByName(pivots), "requests")
    rows = texts.select("id", "text").join(requests, "id")
    streamed = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                part = batch.slice(start, PART)
                pivot, salts, member = (part.column(c).to_pylist() for c in ("pivot", "salt", "member"))
                found = []
                for i, words in enumerate(text_words(part.column("text").to_pylist())):
                    if (pivot[i], salts[i]) != at:
                        at, own = (pivot[i], salts[i]), []
                    items = shingle_set(words)
                    if not member[i]:
                        own.append(items)
                    elif any(similar(items, p, percent) for p in own):
                        found.append(i)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(found, pa.int64())) for c in ("id", "pivot")], ["a", "b"])

    kind = type_of(edges, "a")
    return streamed.select("id", "pivot", "salt", "member", "text").mapInArrow(tidy(check), f"a {kind}, b {kind}")


def set_tables(texts: DataFrame) -> DataFrame:
    """``id, items``: the sorted set of each text as bytes."""

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                sets = [shingle_set(w).tobytes() for w in text_words(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "items"])

    return texts.select("id", "text").mapInArrow(tidy(hash_sets), f"id {type_of(texts, 'id')}, items binary")


def block_links(component: np.ndarray, pivot: np.ndarray, low: np.ndarray | None, items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components in a block, one per merger. ``low`` parts the two sides of a block of two slices."""
    sizes = np.array([len(x) for x in items], np.int64)
    starts = np.cumsum(sizes) - sizes
    _, codes = np.unique(np.concatenate(items), return_inverse=True)
    own = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    label, links = component.copy(), []
    for i in np.flatnonzero(~pivot & (sizes > 0) if low is None else low & ~pivot & (sizes > 0)):
        take = (label != label[i]) & ~pivot & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        take &= (np.arange(len(sizes)) > i) if low is None else ~low
        at = np.flatnonzero(take)
        if not len(at):
            continue
        mine = codes[starts[i] : starts[i] + sizes[i]]
        own[mine] = True
        for j in np.array_split(at, -(-int(sizes[at].sum()) // 4_000_000)):
            places = np.repeat(starts[j] - (np.cumsum(sizes[j]) - sizes[j]), sizes[j]) + np.arange(sizes[j].sum())
            common = np.add.reduceat(own[codes[places]].astype(np.int64), np.cumsum(sizes[j]) - sizes[j])
            for k in j[100 * common >= percent * (sizes[j] + sizes[i] - common)]:
                if label[k] != label[i]:
                    links.append((int(i), int(k)))
                    label[label == label[k]] = label[i]
        own[mine] = False
    return links


def across_components(rest: DataFrame, percent: int) -> DataFrame:
    """Verified links ``(a, b)`` between components; ``rest`` has ``key, size, id, component, is_pivot, items``."""
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = (
        rest.withColumn("own", F.pmod(F.xxhash64("id"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .select("key", "lo", "hi", (F.col("own") == F.col("lo")).alias("low"), "id", F.xxhash64("component").alias("component"), "is_pivot", "items")
    )
    streamed = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: pa.Table) -> pa.RecordBatch | None:
            component = rows.column("component").to_numpy()
            if rows.num_rows < 2 or (component == component[0]).all():
                return None
            same = rows.column("lo")[0].as_py() == rows.column("hi")[0].as_py()
            pivot, low = (rows.column(c).to_numpy() for c in ("is_pivot", "low"))
            items = [np.frombuffer(x, np.uint64) for x in rows.column("items").to_pylist()]
            found = block_links(component, pivot, None if same else low, items, percent)
            if not found:
                return None
            ids = rows.column("id").combine_chunks()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(side, pa.int64())) for side in zip(*found)], ["a", "b"])

        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if held and at != tuple(keys[a]):
                    if out := links(pa.concat_tables(held)):
                        yield out
                    held = []
                at = tuple(keys[a])
                held.append(table.slice(a, b - a))
        if held and (out := links(pa.concat_tables(held))):
            yield out

    kind = type_of(rest, "id")
    return streamed.mapInArrow(tidy(compare), f"a {kind}, b {kind}")


def linked_components(nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``(id, component)`` of the nodes that have a link.

    ``nodes`` has one row per distinct set: ``id, bands``; ``fetch`` turns a table of ids into ``id, text``. Two nodes are linked
    if their full sets have a Jaccard similarity of ``percent`` / 100 or more. ``nodes`` is read twice.
    """
    rows = nodes.select("id", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = kept(rows.join(sizes, "key"), "members")
    scores = members.groupBy("id").agg(F.sum("size").alias("score"))
    order = F.col("score") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))  # ties fall the same way everywhere
    pivots = kept(members.join(scores, "id").groupBy("key").agg(F.max_by("id", order).alias("pivot")), "pivots")
    edges = members.join(pivots, "key").filter("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    near = kept(fetch(members.select("id").distinct()), "texts")
    edges = kept(edges, "edges")
    first = kept(verified(edges, near, percent), "links")
    stars = kept(components(first), "stars")

    label = F.coalesce("component", "id").alias("component")
    labelled = members.filter("size > 2").join(stars, "id", "left").select("key", "id", "size", label)
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
    open_rows = kept(labelled.join(open_keys, "key").join(pivots, "key"), "rest")
    sets = set_tables(near.join(open_rows.select("id").distinct(), "id"))
    rest = open_rows.join(sets, "id").select("key", "size", "id", "component", (F.col("id") == F.col("pivot")).alias("is_pivot"), "items")
    found = components(first.unionByName(across_components(rest, percent)))  # checkpointed: what it came from may go
    discard(members, pivots, edges, near, first, stars, open_rows)
    return found
