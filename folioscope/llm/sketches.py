"""Fast similarity sketches of sets of hashes, and the band keys made of them.

Round by round every element of a set is thrown into one of ``t`` bins at a hashed value in [0, 1) plus the round's
number; a bin keeps its least value. After the first ``t`` rounds of throws to hashed bins, round ``t + j`` throws all elements
into bin ``j``, so every coordinate is filled. A set is done as soon as all its bins are: after one round for
a set much larger than ``t log t``. Two sets agree in a coordinate with their Jaccard similarity as probability,
and the share of equal coordinates is concentrated around it.
"""

from __future__ import annotations

import math

import numpy as np

from folioscope.llm.shingles import mixed

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(sets: list[np.ndarray], t: int, seed: int = 0) -> np.ndarray:
    """One row of ``t`` coordinates per set; the row of an empty set is all ``EMPTY``."""
    out = np.full((len(sets), t), EMPTY, np.uint64)
    flat = out.reshape(-1)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    sizes = np.array([len(sets[i]) for i in todo], np.int64)
    items = np.concatenate([sets[i] for i in todo]) if len(todo) else np.zeros(0, np.uint64)
    for r in range(2 * t):
        if not len(todo):
            break
        own = np.uint64((seed * 2 * t + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = mixed(items ^ mixed(np.array([own]))[0])
        value = (np.uint64(r) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF))
        if r < t:
            bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(x), r - t, np.int64)
        np.minimum.at(flat, np.repeat(todo * t, sizes) + bins, value)
        open_ = (out[todo] == EMPTY).any(1)
        if not open_.all():
            items = items[np.repeat(open_, sizes)]
            todo, sizes = todo[open_], sizes[open_]
    return out


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band of ``rows`` coordinates; the band's number is part of it."""
    bands = sketches.shape[1] // rows
    own = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketches), bands))
    for k in range(rows):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + own[:, :, k])
    return key


def tuned_bands(threshold: float, miss: float, most: int) -> tuple[int, int]:
    """``(bands, rows)``: the most rows per band, that is the fewest chance candidates, at which a pair of
    the threshold's similarity is missed with probability ``miss`` at most by up to ``most`` coordinates."""
    for rows in range(most, 1, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            return bands, rows
    return most, 1
