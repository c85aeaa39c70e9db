"""Word-shingle signatures shared by the near-duplicate operators.

Words are the maximal runs of letters or digits of ``lower(a + ' ' + b)``; a
row's set holds the 40-bit hashes of its distinct runs of ``k`` words (two
different shingles of a pair of usual length share a hash once in 10**8 pairs).  Likeness
is the Jaccard similarity of two sets.  All of it works on whole texts and on
Arrow batches at once; nothing here is per row but the word split.

For a likeness of at least ``t`` the sets differ in at most
``(1-t)/(1+t) * (|A|+|B|)`` elements.  That bound drives every exact filter:
the number of elements in a prefix, the sizes that can match, and the Hamming
radius of fingerprints.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
HASH_BITS = 40
_CACHE_MAX = 400_000
EPS = 1e-9


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], k: int = 3, min_words: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): row i's sorted distinct shingle hashes end at ends[i].

    A row of fewer than ``min_words`` (or ``k``) words has an empty set.
    """
    if len(_words) > _CACHE_MAX:
        _words.clear()
    lens = np.empty(len(texts), np.int64)
    flat: list[int] = []
    get = _words.__getitem__
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        if len(words) < max(min_words, k):
            lens[i] = 0
            continue
        lens[i] = len(words)
        flat.extend(map(get, words))
    h = np.array(flat, np.uint64)
    row = np.repeat(np.arange(len(texts)), lens)
    if h.size < k:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    n = h.size - k + 1
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for j in range(1, k):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    inside = row[:n] == row[k - 1 :]
    s, row = s[inside], row[:n][inside]
    # One sort of (row, hash) in 64 bits; hashes keep HASH_BITS of them.
    parts, step = [], 1 << (64 - HASH_BITS)
    bounds = np.searchsorted(row, np.arange(0, len(texts) + step, step))
    for at, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        key = (row[lo:hi] - at * step).astype(np.uint64) << np.uint64(HASH_BITS) | s[lo:hi] >> np.uint64(64 - HASH_BITS)
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        parts.append((key << np.uint64(64 - HASH_BITS), (key >> np.uint64(HASH_BITS)).astype(np.int64) + at * step))
    s, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    return s, np.cumsum(np.bincount(row, minlength=len(texts)))


def pack(s: np.ndarray) -> bytes:
    """Hashes as HASH_BITS / 8 bytes each, in their order."""
    return np.ascontiguousarray((s >> np.uint64(64 - HASH_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8]).tobytes()


def unpack(raw: np.ndarray) -> np.ndarray:
    """The hashes of packed bytes, as numbers below 2**HASH_BITS."""
    wide = np.zeros((len(raw) * 8 // HASH_BITS, 8), np.uint8)
    wide[:, : HASH_BITS // 8] = raw.reshape(-1, HASH_BITS // 8)
    return wide.view("<u8").ravel()


def slot(h: np.ndarray, width: int) -> np.ndarray:
    """The counter of each hash among ``width``, a power of two."""
    return (h >> np.uint64(65 - int(width).bit_length())).astype(np.int64)


def prefix_len(n: np.ndarray, t: float) -> np.ndarray:
    """Elements of a set of n that must hold one in common with any set of likeness >= t."""
    return n - np.ceil(t * n - EPS).astype(np.int64) + (n > 0)


def short_prefix_len(n: np.ndarray, t: float) -> np.ndarray:
    """The same against sets that are not smaller."""
    return n - np.ceil(2 * t / (1 + t) * n - EPS).astype(np.int64) + (n > 0)


def radius(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Most elements in which sets of these sizes may differ at likeness >= t."""
    return np.floor((1 - t) / (1 + t) * (a + b) + EPS).astype(np.int64)


def ranked_prefixes(s: np.ndarray, ends: np.ndarray, counts: np.ndarray, t: float):
    """(hash, row, pos, size) of the prefix elements, rows' rarest elements first.

    counts: how many rows of the corpus hold a shingle of each slot.  Any
    total order of the shingles gives exact results; this one makes lists short.
    """
    sizes = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(ends.size), sizes)
    c = counts[slot(s, len(counts))]
    level = np.minimum(np.where(c < 256, c, 256 + 32 * np.log2(np.maximum(c, 1) / 256.0)), 1023).astype(np.uint64)
    # The order is (level, hash); as one number while rows are few.
    if ends.size <= 1 << 14:
        order = np.argsort(row.astype(np.uint64) << np.uint64(50) | level << np.uint64(HASH_BITS) | s >> np.uint64(64 - HASH_BITS))
    else:
        order = np.lexsort((s, level, row))
    s = s[order]
    pos = np.arange(s.size) - np.repeat(ends - sizes, sizes)
    keep = pos < prefix_len(sizes, t)[row]
    return s[keep], row[keep], pos[keep], sizes


def odd_sketch(s: np.ndarray, ends: np.ndarray, words: int = 2) -> np.ndarray:
    """Parity fingerprints of 64*words bits: two sets' Hamming distance is at most the size of their difference.

    Every element flips one bit, so elements in common cancel and each other
    element changes at most one bit: the distance never overstates.
    """
    bit = (mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(40)).astype(np.int64) % (64 * words)
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((ends.size, words), np.uint64)
    full = sizes > 0
    if full.any():
        starts = (ends - sizes)[full]
        for w in range(words):
            flips = np.where(bit >> 6 == w, np.uint64(1) << (bit & 63).astype(np.uint64), np.uint64(0))
            out[full, w] = np.bitwise_xor.reduceat(flips, starts)
    return out
