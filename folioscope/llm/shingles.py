"""Hashed words and shingles of UTF-8 texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes worked on at a time; a slice ends where a word ends.
SLICE = 1 << 20
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
WORDS_PER_SHINGLE = 5

_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get(0, (np.zeros(0),))[0].size < n:
        size = max(n, SLICE + 4096)
        _powers[0] = tuple(np.cumprod(np.full(size, s, np.uint64)) for s in (STEP, STEP_BACK))
    return _powers[0]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, start)`` of the words ``[^\\x20\\x09-\\x0D]+`` of ``data``, A-Z in lower case.

    A word's hash is a polynomial in a table value per byte, from prefix sums modulo 2**64, mixed.
    """
    data = data.translate(_LOWER)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        part = np.frombuffer(data, np.uint8, end - at, at)
        inside = ~_BLANK[part]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        up, back = _powers_to(end - at)
        sums = np.zeros(end - at + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: end - at], out=sums[1:])
        hashes.append(mixed((sums[last] - sums[first]) * back[first]))
        starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingles(words: np.ndarray, n: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Hashes of the ``n``-word shingles in order; of fewer words the whole sequence is one, of none none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    many, size = (len(words) - n + 1, n) if len(words) >= n else (1, len(words))
    total = np.full(many, size, np.uint64)
    for k in range(size):
        total = total * STEP + words[k : k + many]
    return mixed(total)


def shingle_set(words: np.ndarray, n: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    found = np.sort(shingles(words, n))
    return found[np.diff(found, prepend=~found[:1]) != 0] if len(found) else found


def text_words(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text; short texts are hashed together."""
    group: list[bytes] = []
    size = 0

    def hashed() -> Iterator[np.ndarray]:
        words, starts = word_hashes(b"\n".join(group))
        ends = np.cumsum([len(g) + 1 for g in group])
        cuts = np.searchsorted(starts, ends)
        for a, b in zip([0, *cuts[:-1]], cuts):
            yield words[a:b]

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(data) > SLICE:
            yield from hashed()
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield from hashed()


def digest(words: np.ndarray) -> bytes:
    """128 bits for a word sequence."""
    place = mixed(np.arange(1, len(words) + 1, dtype=np.uint64))
    halves = [int((mixed(words * np.uint64(2) + np.uint64(1) ^ place * s)).sum(dtype=np.uint64)) for s in (STEP, STEP_BACK)]
    return b"".join(h.to_bytes(8, "little") for h in halves)


def set_digest(items: np.ndarray) -> bytes:
    """128 bits for a sorted set of hashes."""
    halves = [int(mixed(items ^ s).sum(dtype=np.uint64)) for s in (STEP, STEP_BACK)]
    return b"".join((h + len(items) & (1 << 64) - 1).to_bytes(8, "little") for h in halves)


def shingle_sets(words: list[np.ndarray], n: int = WORDS_PER_SHINGLE) -> tuple[list[np.ndarray], list[bytes]]:
    """``shingle_set`` and ``set_digest`` of every word sequence; sequences of ``n`` words or more are hashed together."""
    sets = [np.zeros(0, np.uint64)] * len(words)
    digests = [set_digest(sets[0])] * len(words) if words else []
    long = [i for i, w in enumerate(words) if len(w) >= n]
    for i in set(range(len(words))).difference(long):
        sets[i] = shingle_set(words[i], n)
        digests[i] = set_digest(sets[i])
    if not long:
        return sets, digests
    found = shingles(np.concatenate([words[i] for i in long]), n)
    ends = np.cumsum([len(words[i]) for i in long])
    starts = ends - [len(words[i]) for i in long]
    fresh = np.ones(len(found), bool)
    for a, b in zip(starts.tolist(), ends.tolist()):
        found[a : b - n + 1].sort()
        fresh[b - n + 1 : b] = False  # these reach into the next sequence
    fresh[1:] &= found[1:] != found[:-1]
    fresh[starts] = True
    sizes = np.add.reduceat(fresh.astype(np.int64), starts)
    items = found[fresh]
    cuts = np.cumsum(sizes)
    low, high = ((np.add.reduceat(mixed(items ^ s), cuts - sizes) + sizes.astype(np.uint64)).astype("<u8") for s in (STEP, STEP_BACK))
    for k, (i, end, size) in enumerate(zip(long, cuts.tolist(), sizes.tolist())):
        sets[i], digests[i] = items[end - size : end], low[k].tobytes() + high[k].tobytes()
    return sets, digests
