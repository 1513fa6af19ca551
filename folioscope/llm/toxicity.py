"""Toxicity of whole texts: a support vector machine on a gapped-subsequence string kernel of words.

Kernel. A word is a string of lower-case letters between two end marks. Its features are the subsequences u of three letters whose places span at
most ``SPAN`` letters, each occurrence weighted with ``DECAY ** span``; k(w, z) is the inner product of the features, divided by a
norm that hangs on the two lengths. Letters put in between or left out lower k a little, and do not end it.

Machine. Landmarks z are words from the labelled sentences; k against them, times the inverse root of the
landmarks' own kernel matrix, gives Nystroem features, on which a linear squared-hinge SVM is fitted. A sentence
scores as its worst word and a text as its worst sentence, so in each round a labelled text stands with its worst
sentence so far; the words that clean texts were accused of stay as counter-examples. The decision sum over landmarks is
linear in the subsequence features, so one weight per subsequence (64 ** 3) scores a word exactly.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.langid import code_points, groups
from folioscope.llm.names import free
from folioscope.llm.workers import tidy

DECAY = 0.6
SPAN = 6
SHORTEST = 3  # words of fewer letters have the value of no word
LONGEST = 24  # letters of a word looked at together; longer ones are cut into overlapping parts
LETTERS = 64
#: Labelled texts that are learned from, toxic and clean; more are thinned by a hash of the row.
MOST_TOXIC, MOST_CLEAN = 2_000, 12_000
LANDMARKS = 384
ROUNDS = 4
WORDS = 6  # words that a sentence hands on
COST = 4.0
#: A word whose value (see ``word_values``) and number of toxic sentences reach these is taken as a toxic sentence itself.
TELLING, LEAST_SENTENCES = 2.19, 4
MOST_TOLD = 1_000
PREDICT_AT = 0.3

# Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

BLANK, STOP, OTHER, SIGN = 0, 100, 101, 128
EDGE = 63  # the mark before and after a word


@functools.cache
def letter_table() -> np.ndarray:
    """Code point to 1-26 (a-z), 27-58 (the letters of U+00DF to U+00FF), 59-62 (other letters without their
    accents, or by number), or BLANK, STOP (ends a sentence), OTHER (dropped) or SIGN plus the letter that a sign may stand for."""
    table = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()[0]
            low = low if low <= "\xff" else unicodedata.normalize("NFD", low)[0]
            table[i] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) - 0xDF if "\xdf" <= low <= "\xff" else 59 + i % 4
        elif c.isspace():
            table[i] = STOP if c == "\n" else BLANK
    for c in ".?;:":
        table[ord(c)] = STOP
    for sign, letter in SIGNS.items():
        table[ord(sign)] = SIGN + ord(letter) - 96
    return table


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(letters, start, length, sentence)`` of the words of texts, and each sentence's text as ``owner``.

    A sign that leads on to a letter is read as a letter, others are dropped; a stop counts only before a blank;
    single letters in a row are one word, so gapped words come together.
    """
    table = letter_table()
    codes = [code_points(t + "\n") for t in texts]
    owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    kinds = table[np.concatenate(codes)] if codes else np.zeros(0, np.uint8)
    sign = np.flatnonzero(kinds > SIGN)
    for at in sign[::-1].tolist():  # from the right: a run of signs counts if a letter follows it
        follows = kinds[at + 1] if at + 1 < len(kinds) else STOP
        kinds[at] = kinds[at] - SIGN if 0 < follows < LETTERS else OTHER
    after = np.append(kinds[1:], STOP)
    newline = np.concatenate(codes) == 10 if codes else np.zeros(0, bool)
    stop = (kinds == STOP) & ((after == BLANK) | (after == STOP) | newline)
    gap = (kinds == BLANK) | stop
    letter = (kinds > 0) & (kinds < LETTERS)
    sentence = np.cumsum(stop) - stop
    # a word is numbered by the gaps before its letters
    word = np.cumsum(gap)[letter]
    letters, sentence, owner = kinds[letter], sentence[letter], owner[letter]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    length = np.diff(np.append(first, len(word)))
    single = length == 1
    joins = np.zeros(len(first), bool)
    joins[1:] = single[1:] & single[:-1] & (sentence[first[1:]] == sentence[first[:-1]])
    first = first[~joins]
    length = np.diff(np.append(first, len(word)))
    if len(length) and length.max() > LONGEST:  # overlapping parts
        parts = np.maximum(-(-(length - LONGEST // 2) // (LONGEST // 2)), 1)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(first, parts) + step * (LONGEST // 2)
        length = np.minimum(np.repeat(first + length, parts) - begin, LONGEST)
        first = begin
    return letters, first, length, np.stack([sentence[first], owner[first]]) if len(first) else np.zeros((2, 0), np.int64)


def as_strings(letters: np.ndarray, first: np.ndarray, length: np.ndarray) -> list[str]:
    data = (letters + 96).astype(np.uint8).tobytes().decode("latin-1")
    return [data[a : a + n] for a, n in zip(first.tolist(), length.tolist())]


def as_letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8) - 96
    return letters, np.cumsum(length) - length, length


OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
LENGTH_NORM = np.sqrt([max(sum(max(n + 2 - a - b, 0) * DECAY ** (2 * (a + b + 1)) for a, b in OFFSETS), 1e-12) for n in range(LONGEST + 1)])


def occurrences(letters: np.ndarray, first: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """``(word, subsequence, weight)`` for each pair of offsets, over all words at once."""
    word = np.repeat(np.arange(len(first)), length)
    place = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length)
    room = np.repeat(first + length, length) - place  # letters from here to the word's end
    codes = letters.astype(np.int64)
    for a, b in OFFSETS:
        weight = DECAY ** (a + b + 1)
        at = np.flatnonzero(room > a + b)
        i = place[at]
        yield word[at], (codes[i] * LETTERS + codes[i + a]) * LETTERS + codes[i + a + b], weight
        at = np.flatnonzero(length > a + b - 1)  # from the mark before the word, and to the mark after it
        i, j = first[at], (first + length)[at]
        yield at, (EDGE * LETTERS + codes[i + a - 1]) * LETTERS + codes[i + a + b - 1], weight
        yield at, (codes[j - a - b] * LETTERS + codes[j - b]) * LETTERS + EDGE, weight


def by_word(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, subsequence, weight)`` of all occurrences, in the words' order, scaled by the lengths' norm."""
    letters, first, length = as_letters(words)
    found = [(w, u, np.full(len(w), weight)) for w, u, weight in occurrences(letters, first, length)]
    word, u, weight = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(word, kind="stable")
    return word[order], u[order], weight[order] / LENGTH_NORM[length[word[order]]]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(columns, rows)``: the subsequences that occur in the words, and each word's features for them."""
    word, u, weight = by_word(words)
    columns, at = np.unique(u, return_inverse=True)
    rows = np.zeros((len(words), len(columns)), np.float32)
    np.add.at(rows, (word, at), weight.astype(np.float32))
    return columns, rows


def weighted(weights: np.ndarray, letters: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Inner product of each word's scaled features with ``weights``."""
    total = np.zeros(len(first))
    for word, u, weight in occurrences(letters, first, length):
        total += np.bincount(word, weights[u], len(first)) * weight
    return total / LENGTH_NORM[length]


def against(columns: np.ndarray, rows: np.ndarray, words: list[str]) -> np.ndarray:
    """The kernel of each word with each of the ``rows`` of features."""
    out = np.zeros((len(words), len(rows)), np.float32)
    for begin in range(0, len(words), 4_000):  # some words at a time, for the driver's memory
        word, u, weight = by_word(words[begin : begin + 4_000])
        at = np.minimum(np.searchsorted(columns, u), len(columns) - 1)
        known = columns[at] == u
        word, at, weight = word[known], at[known], weight[known].astype(np.float32)
        if len(word):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            for k, row in enumerate(rows):
                out[begin + word[starts], k] = np.add.reduceat(row[at] * weight, starts)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST, rounds: int = 20) -> np.ndarray:
    """Weights (the last is the bias) of the squared-hinge SVM: Newton steps on the rows inside the margin, halved while
    they do not lower the objective."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = cost * weight
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-2

    def objective(w: np.ndarray) -> float:
        return float(ridge @ (w * w) + share @ np.maximum(1 - y * (x @ w), 0) ** 2)

    w = np.zeros(x.shape[1])
    now = objective(w)
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        own = x[inside] * share[inside][:, None]
        step = np.linalg.solve(np.diag(ridge) + own.T @ x[inside], own.T @ y[inside]) - w
        size = 1.0
        while size > 1e-4 and objective(w + size * step) >= now:
            size /= 2
        new = objective(w + size * step)
        if new >= now * (1 - 1e-4):
            break
        w, now = w + size * step, new
    return w


def calibrated(value: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through decision values."""
    a, b = 1.0, 0.0
    target = np.where(positive, (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * value + b, -35, 35)))
        x = np.stack([value, np.ones(len(value))], 1)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-3 * np.array([a, b]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


@dataclass
class Toxicity:
    """``weights`` per subsequence and ``bias`` give a word's decision value; ``slope`` and ``shift`` a text's score.

    ``known`` holds values of single words instead (the first round, before a machine is there).
    """

    weights: np.ndarray | None = None
    bias: float = -1.0
    slope: float = 1.0
    shift: float = 0.0
    known: dict[str, float] | None = None

    def words(self, texts: list[str | None]) -> Iterator[tuple]:
        """(rows, letters, start, length, sentence, owner, value) group by group; equal words are valued once."""
        for group in groups(texts):
            letters, first, length, (sentence, owner) = words_of([texts[i] or "" for i in group])
            if self.known is not None:
                value = np.array([self.known.get(w, -1.0) for w in as_strings(letters, first, length)])
            elif self.weights is None or not len(first):
                value = np.full(len(first), self.bias)
            else:
                up = np.cumprod(np.full(LONGEST + 1, 0x9E3779B97F4A7C15, np.uint64))
                key = length.astype(np.uint64)
                for k in range(int(length.max())):
                    has = length > k
                    key[has] += up[k] * (letters[first[has] + k].astype(np.uint64) + np.uint64(1))
                _, at, back = np.unique(key, return_index=True, return_inverse=True)
                value = weighted(self.weights, letters, first[at], length[at]) + self.bias
                value = np.where(length[at] < SHORTEST, self.bias, value)[back]
            yield group, letters, first, length, sentence, owner, value

    def decide(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """Each text's decision value, and its worst word; a text without words has the bias."""
        value, worst = np.full(len(texts), self.bias), [None] * len(texts)
        for group, letters, first, length, _, owner, v in self.words(texts):
            order = np.lexsort((-v, owner))
            top = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
            for k, word in zip(top, as_strings(letters, first[top], length[top])):
                row = group[owner[k]]
                value[row], worst[row] = max(v[k], self.bias), word
        return value, worst

    def score(self, value: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(value))
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -500, 500)))


def worst_sentences(texts: DataFrame, model: Toxicity) -> pd.DataFrame:
    """``id, toxic, words, value``: for each text the worst words of its worst sentence."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("text").to_pylist()
            words: list[list[str]] = [[] for _ in rows]
            value = np.full(len(rows), shared.value.bias)
            for group, letters, first, length, sentence, owner, v in shared.value.words(rows):
                order = np.lexsort((-v, owner))
                top = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
                for k in top:
                    own = np.flatnonzero(sentence == sentence[k])
                    own = own[np.argsort(-v[own], kind="stable")][:WORDS]
                    words[group[owner[k]]] = as_strings(letters, first[own], length[own])
                    value[group[owner[k]]] = v[k]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(words, pa.list_(pa.string())), pa.array(value)], ["id", "toxic", "words", "value"])

    kind = texts.schema["id"].dataType.simpleString()
    picked = texts.select("id", "toxic", "text").mapInArrow(tidy(pick), f"id {kind}, toxic int, words array<string>, value double")
    return picked.orderBy("id").toPandas()  # a row of WORDS words per row of the bounded sample


def word_values(texts: DataFrame, most: int = 20_000) -> dict[str, tuple[float, int]]:
    """Words with their value and their number of toxic sentences; the ``most`` telling ones.

    The value is the logarithm of the odds that a sentence with the word is toxic. A sentence counts once however often it is
    copied, and as clean if a clean text holds it, so what is copied with an insult is not taken for one.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Toxicity()
        for batch in batches:
            flags = batch.column("toxic").to_pylist()
            for group, letters, first, length, sentence, owner, _ in plain.words(batch.column("text").to_pylist()):
                words = as_strings(letters, first, length)
                cuts = [*np.flatnonzero(np.diff(sentence, prepend=-1)).tolist(), len(words)]
                found = [sorted({w for w in words[a:b] if len(w) >= SHORTEST}) for a, b in zip(cuts, cuts[1:])]
                toxic = [flags[group[owner[a]]] for a in cuts[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), pa.array(toxic, pa.int32())], ["words", "toxic"])

    sentences = texts.select("toxic", "text").mapInArrow(tidy(split), "words array<string>, toxic int").groupBy("words").agg(F.min("toxic").alias("toxic"))
    counts = sentences.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5))
    top = counts.filter("t > 0").select("word", odds.alias("v"), "t").orderBy(F.desc(F.col("v") + F.log1p("t")), "word").limit(most)
    return {r.word: (r.v, r.t) for r in top.collect()}


def disturbed(words: list[str], each: int = 2, seed: int = 1) -> list[str]:
    """Words with a letter put in somewhere inside: the machine must take them for the words they came from."""
    rng = np.random.default_rng(seed)
    out = []
    for w in words:
        for _ in range(each if len(w) > 3 else 0):
            at = int(rng.integers(1, len(w)))
            out.append(w[:at] + chr(97 + int(rng.integers(26))) + w[at:])
    return out


def train(labelled: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Toxicity:
    """Learn from ``labelled`` (``id, text, toxic``), at most about ``most_toxic`` and ``most_clean`` rows (the documented bound).

    Rows without text or label are passed over; with one class only, or none, every text scores 0.
    """
    rows = labelled.select("id", "text", (F.col("toxic") > 0).cast("int").alias("toxic")).filter("text is not null and toxic is not null")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return Toxicity()
    slot = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 20))
    keep = {k: int(min(1.0, most / sizes[k]) * (1 << 20)) + 1 for k, most in ((1, most_toxic), (0, most_clean))}
    sample = rows.filter(slot < F.when(F.col("toxic") == 1, keep[1]).otherwise(keep[0])).checkpoint()
    values = word_values(sample)
    told = {w: float(np.sqrt(t)) for w, (v, t) in list(values.items())[: 4 * MOST_TOLD] if v >= TELLING and t >= LEAST_SENTENCES}
    told = dict(list(told.items())[:MOST_TOLD])
    more = {w: 0.5 for w in disturbed(list(told)) if w not in told}
    model = Toxicity(known={w: v + np.log1p(t) for w, (v, t) in values.items()})
    clean: Counter = Counter()  # every word of a clean text is clean; how many texts it was the worst of
    for _ in range(rounds):
        found = worst_sentences(sample, model)
        accused = Counter(ws[0] for ws, t in zip(found["words"], found["toxic"]) if not t and len(ws))
        seen = {w for ws, t in zip(found["words"], found["toxic"]) if not t for w in ws[:2]}
        clean = Counter({w: clean[w] + accused[w] for w in seen | set(clean) if len(w) >= SHORTEST and w not in told and w not in more})
        toxic = [list(ws) for ws, t in zip(found["words"], found["toxic"]) if t and len(ws)]
        model = machine(toxic, told, more, clean, landmarks)
    found = worst_sentences(sample, model)
    model.slope, model.shift = calibrated(found["value"].to_numpy(float), found["toxic"].to_numpy() == 1)
    return model


def machine(toxic: list[list[str]], told: dict[str, float], more: dict[str, float], clean: Counter, landmarks: int) -> Toxicity:
    """The SVM for toxic sentences, each a list of words, worst first, for words that are toxic sentences themselves, with weights,
    and for words of clean sentences.

    Landmarks are words that tell toxic texts, up to half of all, and those that clean texts were accused of most often."""
    words = sorted({w for ws in toxic for w in ws} | set(clean) | set(told) | set(more))
    if not toxic or not clean:
        return Toxicity()
    at = {w: i for i, w in enumerate(words)}
    lead = Counter(ws[0] for ws in toxic)
    chosen = dict.fromkeys([*told, *sorted(lead, key=lambda w: (-lead[w], w))][: landmarks // 2])
    chosen |= dict.fromkeys(sorted(clean, key=lambda w: (-clean[w], w))[: landmarks - len(chosen)])
    columns, z = features(list(chosen))
    spec, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = spec > 1e-5 * spec.max(initial=1e-12)
    root = vectors[:, good] / np.sqrt(spec[good])
    nystroem = against(columns, z, words) @ root.astype(np.float32)
    fixed = [at[w] for w in [*told, *more, *sorted(clean)]]
    weight = np.concatenate([list(told.values()), list(more.values()), 1 + np.log1p([clean[w] for w in sorted(clean)]), np.ones(len(toxic))])
    y = np.repeat([1.0, -1.0, 1.0], [len(told) + len(more), len(clean), len(toxic)])
    # a sentence stands with the word that the machine before thinks worst; then with the new one's
    choice = [at[ws[0]] for ws in toxic]
    for _ in range(2):
        w = fit_svm(nystroem[fixed + choice], y, weight)
        value = nystroem @ w[:-1] + w[-1]
        choice = [max((at[x] for x in ws), key=lambda i: value[i]) for ws in toxic]
    weights = np.zeros(LETTERS**3)
    weights[columns] = (root @ w[:-1]) @ z
    return Toxicity(weights=weights, bias=float(w[-1]))


def assess(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``worst_word`` (folded letters); only the text is looked at.

    Null and empty texts score as a text without insults; whole texts are read, some at a time; columns named like the new
    ones are replaced; repeated rows and an empty table give what they hold. The model, a number per subsequence, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("toxicity", "worst_word")]
    own = text if text in names else free(names, "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                value, worst = shared.value.decide(part.column(own).to_pylist())
                columns = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.score(value)), pa.array(worst, pa.string())], [*names, "toxicity", "worst_word"])

    rows = docs.select(*names) if own == text else docs.select(*names, F.col(text).alias(own))
    return rows.mapInArrow(tidy(score), f"{schema}, toxicity double, worst_word string")
