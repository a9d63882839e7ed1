"""Word sequences of operator 6: occurrence-labelled k-mers, order-MinHash sketches and banded alignment."""

from __future__ import annotations

import re
from math import ceil

import numpy as np
import xxhash

#: Words of a shingle (k-mer); sketches of a text; k-mers that each sketch keeps in text order.
K, SKETCHES, KEPT = 5, 56, 3
#: Share of the longer text's words that the alignment matches, from which two texts are near duplicates.
SIMILARITY = 0.8
#: Hashes that are made at once; rows of the alignment that share one window.
TOGETHER, ROWS = 2_000_000, 2_048

_WORDS = re.compile(r"[^\W_]+").findall
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SEEDS = np.random.default_rng(6).integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
_ODD = np.random.default_rng(7).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower().encode())


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words(text: str, memo) -> np.ndarray:
    """Hashes of the text's words in order; a text without words is one word of its characters, the empty text has none."""
    found = _WORDS(text)
    if not found:
        return np.array([xxhash.xxh3_64_intdigest(text.encode(), 1)], np.uint64) if text else np.empty(0, np.uint64)
    return np.array([memo[w] for w in found], np.uint64)


def kmers(h: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers of word hashes in order, each labelled with which occurrence of it this is; fewer than K words are one k-mer."""
    if not len(h):
        return h
    k = min(K, len(h))
    g = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        g = g * _BASE + h[j : j + len(g)]
    g = mix(g)
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if not new.all():
        at = np.arange(len(s))
        label = np.empty(len(s), np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        g = np.where(label > 0, mix(g + label * _BASE), g)
    return g


def sketches(g: np.ndarray) -> np.ndarray:
    """For each sketch the hash of the KEPT k-mers of least value under the sketch's hash, in the order of the text."""
    if not len(g):
        return np.empty(0, np.int64)
    kept = min(KEPT, len(g))
    at = np.empty((SKETCHES, kept), np.int64)
    step = max(1, TOGETHER // len(g))
    for lo in range(0, SKETCHES, step):
        h = g[None, :] * _ODD[lo : lo + step, None]
        rows = np.arange(len(h))
        for j in range(kept):
            at[lo : lo + step, j] = least = h.argmin(1)
            h[rows, least] = _MOST
    at.sort(axis=1)
    out = _SEEDS.copy()
    for j in range(kept):
        out = mix(out * _BASE + g[at[:, j]])
    return out.view(np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two texts share, repeats counted: no alignment matches more."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.minimum(n, m[at])[y[at] == x].sum())


def _matched(a: list[int], b: list[int], fore: int, back: int) -> int:
    """Words that the best alignment of ``a`` and ``b`` matches within a band: word i of a with words i - fore to i + back of b.

    The rows of the table of longest common subsequences are bit vectors: a bit of ``b`` is
    out where the row grows. ROWS rows share a window somewhat wider than the band.
    """
    row = (1 << len(b)) - 1
    for top in range(0, len(a), ROWS):
        own = a[top : top + ROWS]
        lo, hi = max(0, top - fore), min(len(b), top + len(own) + back)
        if lo >= hi:
            continue
        full = (1 << (hi - lo)) - 1
        wanted, places = set(own), {}
        for j, w in enumerate(b[lo:hi]):
            if w in wanted:
                places[w] = places.get(w, 0) | (1 << j)
        window = (row >> lo) & full
        rest = row ^ (window << lo)
        for w in own:
            if m := places.get(w):
                hit = window & m
                window = ((window + hit) | (window - hit)) & full
        row = rest | (window << lo)
    return len(b) - row.bit_count()


def alignment(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Share of the longer text's words that the best in-order alignment of two texts matches.

    Only matches within the band that the similarity allows count (as far apart as the
    words left out can move them): at or above ``similarity`` the value is exact, below it
    a value below.
    """
    most = max(len(a), len(b))
    if not len(a) or not len(b):
        return 0.0
    need = ceil(similarity * most - 1e-9)
    short = min(len(a), len(b))
    if short < need:
        return min(short, need - 1) / most
    # a common beginning and a common end are in some best alignment
    other = np.flatnonzero(a[:short] != b[:short])
    head = int(other[0]) if len(other) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    other = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(other[0]) if len(other) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    same, left = head + tail, need - head - tail
    if left <= 0 and (not len(a) or not len(b)):
        return same / most
    if min(len(a), len(b)) < left:
        return min(same + min(len(a), len(b)), need - 1) / most
    if (shared := _common(a, b)) < left:
        return min(same + shared, need - 1) / most
    left = max(left, 0)
    return (same + _matched(a.tolist(), b.tolist(), len(a) - left, len(b) - left)) / most
