"""Mixing documents to target weights: iterative proportional fitting of token weights, then seeded sampling.

Documents fall into cells (source, language, topic); every value of a margin counts by itself. Up to ``DRIVER_CELLS`` cells are
raked on the driver and broadcast; more stay a Spark table, of which each step sums what a margin's values have and keeps
a factor per value. The cells' weights are raked until the weighted token sums meet every margin's target shares; a document
is then kept with the probability of its cell, decided by a hash of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.names import free
from folioscope.llm.shingles import mixed, text_words
from folioscope.llm.workers import tidy
from folioscope.session import discard, kept

MARGINS = ("source", "lang", "topic")
TOPICS = 8
DRIVER_CELLS = 50_000
#: Cells with more than this share of the documents are broadcast where the others are too many for it.
HEAVY = 1e-3
POOLED, NONE = "(other)", "(none)"
TOLERANCE, MOST_ROUNDS = 1e-9, 1_000
PART = 512


def with_topic(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """``docs`` with ``tokens`` (words) and ``topic``, where it has none of these columns of its own.

    The topic is a stand-in for tables without topics: the words of the language are dealt to ``topics`` groups by their hash, and a
    text belongs to the group with most of its distinct words (the first of equals; null without words).
    """
    names, schema = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    new = [c for c in ("tokens", "topic") if c not in names]
    if not new:
        return docs
    text = names.index("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                found: dict[str, list] = {"tokens": [], "topic": []}
                for words in text_words(part.column(text).to_pylist()):
                    found["tokens"].append(len(words))
                    if "topic" in new:
                        groups = np.bincount((mixed(np.unique(words)) % np.uint64(topics)).astype(np.int64), minlength=topics)
                        found["topic"].append(f"topic{groups.argmax()}" if len(words) else None)
                made = {"tokens": pa.array(found["tokens"], pa.int64()), "topic": pa.array(found["topic"], pa.string())}
                yield pa.RecordBatch.from_arrays([*part.columns, *[made[c] for c in new]], [*names, *new])

    kinds = {"tokens": "long", "topic": "string"}
    return docs.mapInArrow(tidy(count), ", ".join([schema, *[f"{c} {kinds[c]}" for c in new]]))


def raked(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], tolerance: float = TOLERANCE, rounds: int = MOST_ROUNDS) -> np.ndarray:
    """A weight per cell so that the weighted token shares of margin m's values are ``targets[m]``.

    ``codes[m]`` is each cell's value of margin m. Values without tokens are left out of their margin's targets. Where
    targets contradict each other the weights of the last round are returned.
    """
    weight = np.ones(len(tokens))
    total = tokens.sum()
    if not total:
        return weight
    goals = []
    for code, target in zip(codes, targets):
        there = np.bincount(code, tokens, len(target)) > 0
        goal = np.where(there, target, 0.0)
        goals.append(goal / goal.sum() * total if goal.sum() else np.bincount(code, tokens, len(target)))
    for _ in range(rounds):
        error = 0.0
        for code, goal in zip(codes, goals):
            now = np.bincount(code, weight * tokens, len(goal))
            factor = np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)
            error = max(error, np.abs(now - goal).max() / total)
            weight *= factor[code]
        if error <= tolerance:
            break
    return weight


def named(column: str, values: list[str] | None) -> Column:
    """The column's value, and with ``values`` the pool for what is none of them."""
    value = F.coalesce(F.col(column), F.lit(NONE))
    if values is None:
        return value
    return F.when(value.isin(values), value).otherwise(F.lit(POOLED)) if values else F.lit(POOLED)


class Mixture:
    """``cells`` as rows (values, tokens, weight, probability) with the ``values`` of each margin and their ``targets``; where the
    cells are too many, ``table`` has them and ``cells`` is None. ``pools`` are the values that explicit targets name."""

    def __init__(self, pools: dict[str, list[str]], values=None, cells=None, targets=None, table: DataFrame | None = None):
        self.pools, self.values, self.cells, self.targets, self.table = pools, values, cells, targets, table

    def attach(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``weight`` and ``probability`` of their cells."""
        spark = docs.sparkSession
        names = [c for c in docs.columns if c not in ("weight", "probability")]
        own = {m: free(names, f"_{m}") for m in MARGINS}
        keys = list(own.values())
        keyed = docs.select(*names, *[named(m, self.pools.get(m)).alias(own[m]) for m in MARGINS])
        out = [*names, "weight", "probability"]
        if self.table is None:
            schema = ", ".join(f"`{k}` string" for k in keys) + ", weight double, probability double"
            table = spark.createDataFrame([(*c[: len(MARGINS)], c[-2], c[-1]) for c in self.cells], schema)
            return keyed.join(F.broadcast(table), keys).select(*out)
        columns = [*[F.col(m).alias(own[m]) for m in MARGINS], "weight", "probability"]
        heavy, light = F.broadcast(self.table.filter("heavy").select(*columns)), self.table.filter("not heavy").select(*columns)  # heavy: fewer than 1 / HEAVY
        light_rows = keyed.join(heavy, keys, "left_anti").join(light, keys)
        return keyed.join(heavy, keys).select(*out).unionByName(light_rows.select(*out))


def raked_table(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``cells`` (margins, ``t``) with ``weight``: as ``raked``, by joins. ``goals[m]`` has ``m, goal``, the goals in tokens.

    A weight is the product of a factor per margin; a step finds one margin's factors from the others'.
    """
    factors = {m: kept(goals[m].select(m, F.lit(1.0).alias(f"f_{m}")), "factors") for m in MARGINS}
    total = cells.agg(F.sum("t")).first()[0]

    def weighed(left_out: str | None = None) -> DataFrame:
        rows, weight = cells, F.lit(1.0)
        for m in MARGINS:
            if m != left_out:
                rows, weight = rows.join(factors[m], m), weight * F.col(f"f_{m}")
        return rows.select(*MARGINS, "t", "n", weight.alias("weight"))

    for _ in range(rounds if total else 0):
        error = 0.0
        for m in MARGINS:
            rest = weighed(m).groupBy(m).agg(F.sum(F.col("weight") * F.col("t")).alias("rest"))
            step = rest.join(goals[m], m).join(factors[m].withColumnRenamed(f"f_{m}", "old"), m)
            new = F.when(F.col("rest") > 0, F.col("goal") / F.col("rest")).otherwise(0.0)
            step = kept(step.select(m, new.alias(f"f_{m}"), F.abs(F.col("rest") * F.col("old") - F.col("goal")).alias("off")), "factors")
            error = max(error, step.agg(F.max("off")).first()[0] / total)
            discard(factors[m])
            path = step.kept_in
            factors[m] = step.drop("off")
            factors[m].kept_in = path
        if error <= tolerance:
            break
    return weighed()


def fit(measured: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.5, driver_cells: int = DRIVER_CELLS) -> Mixture:
    """The mixture for ``measured`` (``source, lang, topic, tokens``).

    ``targets`` gives shares per margin and value, the values it does not name sharing ``(other)``; in a margin without targets every
    value gets its own share to the ``power``, evened out. Null values are a value of their own. The fullest cell's documents get
    probability one.
    """
    targets = targets or {}
    pools = {m: sorted(k for k in targets[m] if k != POOLED) for m in MARGINS if m in targets}
    keys = [named(m, pools.get(m)).alias(m) for m in MARGINS]
    cells = measured.groupBy(*keys).agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("t"), F.count(F.lit(1)).alias("n"))
    cells = kept(cells, "cells")
    if cells.count() > driver_cells:
        return fit_table(cells, pools, targets, power)
    rows = cells.orderBy(*MARGINS).collect()  # at most driver_cells
    tokens = np.array([r.t for r in rows], float)
    values, codes, goals, shares = {}, [], [], {}
    for m in MARGINS:
        order = [*pools[m], POOLED] if m in pools else sorted({r[m] for r in rows})
        values[m] = pools.get(m, order)
        place = {v: k for k, v in enumerate(order)}
        code = np.array([place[r[m]] for r in rows], int)
        natural = np.bincount(code, tokens, len(order)) if len(rows) else np.zeros(len(order))
        goal = np.array([targets[m].get(v, 0.0) for v in order]) if m in targets else natural**power
        codes.append(code)
        goals.append(goal)
        shares[m] = dict(zip(order, (goal / max(goal.sum(), 1e-300)).tolist()))
    weight = raked(tokens, codes, goals) if len(rows) else np.zeros(0)
    most = max(weight[tokens > 0].max(initial=0.0), 1e-300)
    chance = np.where(tokens > 0, np.minimum(weight / most, 1.0), 1.0)
    return Mixture(pools, values, [(*[r[m] for m in MARGINS], t, float(w), float(p)) for r, t, w, p in zip(rows, tokens.tolist(), weight, chance)], shares)


def fit_table(cells: DataFrame, pools: dict[str, list[str]], targets: dict[str, dict[str, float]], power: float) -> Mixture:
    """``fit`` for ``cells`` (margins, ``t``, ``n``) that are too many for the driver."""
    spark, goals = cells.sparkSession, {}
    total, documents = cells.agg(F.sum("t"), F.sum("n")).first()
    for m in MARGINS:
        natural = cells.groupBy(m).agg(F.sum("t").alias("s"))
        if m in targets:
            named_goals = spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()], f"{m} string, share double")
            natural = natural.join(named_goals, m, "left")
            goal = F.when(F.col("s") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0)
        else:
            goal = F.pow("s", F.lit(power))
        wanted = kept(natural.select(m, "s", goal.alias("g")), "wanted")
        whole = wanted.agg(F.sum("g")).first()[0]
        goals[m] = kept(wanted.select(m, (F.col("g") / whole * total if whole else F.col("s")).alias("goal")), "goals")
    table = kept(raked_table(cells, goals), "weights")
    most = max(table.filter("t > 0").agg(F.max("weight")).first()[0] or 0.0, 1e-300)
    chance = F.when(F.col("t") > 0, F.least(F.col("weight") / most, F.lit(1.0))).otherwise(1.0)
    return Mixture(pools, table=table.select(*MARGINS, "weight", chance.alias("probability"), (F.col("n") > HEAVY * documents).alias("heavy")))


def drawn(seed: int = 23) -> Column:
    """Whether a document is kept: a hash of its id and text against its probability; the same on every run."""
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") / float(1 << 53)
    return uniform < F.col("probability")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.5, seed: int = 23, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``docs`` with ``tokens, topic, weight, probability, sampled``, one row per row.

    Expected token sums of the sampled documents have the target shares. Documents without tokens carry weight but change no
    share; null text has none; equal rows fall alike; an empty table gives no rows. Given columns ``tokens`` (null: none) and ``topic`` are
    used as they are; other columns of the new names are replaced.
    """
    given = [c for c in ("tokens", "topic") if c in docs.columns]
    measured = kept(with_topic(docs.select("source", "lang", "text", *given)).drop("text"), "measured")
    mixture = fit(measured, targets, power, driver_cells)
    rows = mixture.attach(with_topic(docs.select(*[c for c in docs.columns if c != "sampled"])))
    return rows.withColumn("sampled", drawn(seed))
