"""Language of whole texts: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.names import free
from folioscope.llm.workers import tidy

SIZES = (1, 2, 3)
BITS = 15
#: Labelled rows that are learned from; more are thinned by a hash of the row.
MOST_ROWS = 20_000
SMOOTHING = 0.5
#: Beyond so many n-grams evidence grows with the root of their number: neighbouring n-grams are not independent.
FULL_EVIDENCE = 200
UNKNOWN = "und"
CHUNK = 1 << 17  # characters worked on at a time


@functools.cache
def letter_codes() -> np.ndarray:
    """For each code point: its lower-case letter, or 32 for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, owner: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, start)`` of the n-grams of one text that begin at the first ``starts`` places.

    An n-gram counts unless it begins and ends with a blank.
    """
    letters = codes != 32
    buckets, places = [], []
    mixed = codes.astype(np.uint64)
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, max(SIZES) + 1):
        many = min(len(codes) - n + 1, starts)
        if many <= 0:
            break
        key = key[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + mixed[n - 1 :] + np.uint64(n)
        if n in SIZES:
            own = (letters[:many] | letters[n - 1 : n - 1 + many]) & (owner[:many] == owner[n - 1 : n - 1 + many])
            h = key[:many]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            at = np.flatnonzero(own)
            buckets.append((h[at] >> np.uint64(64 - BITS)).astype(np.int64))
            places.append(at)
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(places)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the texts, runs of other characters and the end as one blank, and each place's text."""
    table = letter_codes()
    parts = [code_points(t + "\0") for t in texts]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    codes = table[np.minimum(np.concatenate(parts), 0x10FFFF)] if parts else np.zeros(0, np.uint32)
    blank = codes == 32
    again = np.zeros(len(codes), bool)
    again[1:] = blank[1:] & blank[:-1] & (owner[1:] == owner[:-1])
    return codes[~again], owner[~again]


def groups(texts: list[str | None]) -> Iterator[list[int]]:
    """Rows whose texts come to about a chunk; a long text is a group of its own."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if group and size + len(t or "") > CHUNK:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(t or "")
    if group:
        yield group


def text_counts(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, bucket, which of the rows) of all n-grams of the texts, group by group."""
    for group in groups(texts):
        codes, owner = joined([texts[i] or "" for i in group])
        for at in range(0, len(codes), CHUNK):
            end = at + CHUNK + max(SIZES) - 1  # n-grams that begin in this chunk may end in the next
            bucket, place = grams(codes[at:end], owner[at:end], CHUNK)
            yield group, bucket, owner[at + place]


class Languages:
    """Log-probabilities per n-gram bucket and language; ``2 ** BITS`` rows, one column per language."""

    def __init__(self, names: list[str], counts: np.ndarray, rows: np.ndarray):
        self.names = names
        self.log_p = (np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * len(counts))).astype(np.float32)
        self.prior = np.log((rows + 1) / (rows.sum() + len(rows)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, n = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        for group, bucket, which in text_counts(texts):
            rows = np.asarray(group)
            n[rows] += np.bincount(which, minlength=len(rows))
            for k in range(len(self.names)):
                total[rows, k] += np.bincount(which, self.log_p[bucket, k], minlength=len(rows))
        known = (n > 0) & bool(self.names)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        scaled = total / np.sqrt(np.maximum(n / FULL_EVIDENCE, 1))[:, None] + self.prior
        scaled -= scaled.max(1, keepdims=True)
        p = np.exp(scaled)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p[np.arange(len(p)), best], 0.0)


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", row_id: str = "doc_id", most_rows: int = MOST_ROWS) -> Languages:
    """Learn from rows with a text and a language, at most about ``most_rows`` of them (the documented bound).

    The rows are chosen by a hash of their id, at the share that leaves ``most_rows``. Each task counts n-grams
    per language; the counts are added up by Spark, and the driver gets one number per language and bucket.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(row_id).alias("id")).filter("lang is not null and text is not null")
    names = [(r.lang, r.n) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()]  # one row per language
    n = sum(m for _, m in names)
    share = min(1.0, most_rows / max(n, 1))
    slot = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 20))
    chosen = rows.filter(slot < int(share * (1 << 20)) + 1).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                langs = np.array(part.column(0).to_pylist(), object)
                for group, bucket, which in text_counts(part.column(1).to_pylist()):
                    own = langs[np.asarray(group)][which]
                    for name in set(langs[np.asarray(group)]):
                        sums[name] = sums.get(name, 0) + np.bincount(bucket[own == name], minlength=1 << BITS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    summed = chosen.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table: pd.DataFrame = summed.toPandas()  # at most 2 ** BITS rows per language
    order = {name: k for k, (name, _) in enumerate(names)}
    counts = np.zeros((1 << BITS, len(names)))
    counts[table["bucket"].to_numpy(int), table["lang"].map(order).to_numpy(int)] = table["n"]
    return Languages([name for name, _ in names], counts, np.array([m for _, m in names], float))


def identify(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``; only the text is looked at.

    ``und`` with score 0 where the text is null or holds no letter, or where no language was learned. Texts of any
    length are read whole, a chunk at a time; columns named like the new ones are replaced; repeated rows and an
    empty table give what they hold. The model (2 ** BITS numbers per language) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    own = text if text in names else free(names, "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pred, value = shared.value.predict(part.column(own).to_pylist())
                columns = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(value, pa.float64())], [*names, "lang_pred", "lang_score"])

    rows = docs.select(*names) if own == text else docs.select(*names, F.col(text).alias(own))
    return rows.mapInArrow(tidy(score), f"{schema}, lang_pred string, lang_score double")


def held_out(row_id: str = "doc_id") -> Column:
    """Every fourth document by the checksum of its id; never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(row_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
