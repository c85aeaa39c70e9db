"""Content-defined chunks that are certain to be found again in a shared span.

A gear rolling hash runs over the code points; a cut is a place whose hash is
the least (the last one of equals) of some window of ``WINDOW`` places.  Whether
a place is a cut depends on its surroundings only, so insertions shift chunks
without changing them, and no stretch of ``WINDOW`` places is without a cut.  A
chunk runs from each cut to the first cut at least ``least`` characters on.

Any span of ``span`` characters common to two texts holds a whole chunk of both:
its first window of hashes has a cut within ``GEAR - 1 + WINDOW`` characters, the
chunk ends within ``least + WINDOW`` more, and a place in between that other
surroundings could make a cut would have to undercut the least of a window that
lies in the span.  Hence ``GEAR - 1 + 2 * WINDOW + least <= span + 1``.
"""

from __future__ import annotations

import numpy as np

from lacuna.llm.shingles import mix

GEAR = 16
_TABLE = mix(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_B = np.uint64(0xD1342543DE82EF95)
_B_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LOW = np.uint64(0xFFFFFF)


def sizes_for(span: int) -> tuple[int, int]:
    """(window, least chunk) for spans of at least ``span`` characters."""
    if span < 64:
        raise ValueError("spans of fewer than 64 characters are not supported")
    window = (span * 5 // 8 - GEAR + 2) // 2 - 1
    return min(window, span * 61 // 200), span * 64 // 200


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least(x[i : i + width]) for each i; the last width - 1 places are cut off."""
    done = 1
    while done * 2 <= width:
        x = least(x[:-done], x[done:])
        done *= 2
    return least(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts together, ends)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(t) for t in texts])


def chunks(cps: np.ndarray, ends: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, row, start, length) of the chunks of texts laid end to end."""
    none = np.empty(0, np.int64)
    n = len(cps)
    if n < GEAR + window:
        return none.astype(np.uint64), none, none, none
    sizes = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(ends)), sizes)
    rel = np.arange(n) - np.repeat(ends - sizes, sizes)
    g = _TABLE[cps & np.uint32(0xFFFF)]
    with np.errstate(over="ignore"):
        h, width = g, 1
        while width < GEAR:  # h[i]: the hash of the ``width`` code points up to i
            h = np.concatenate((h[:width], h[width:] + (h[:-width] << np.uint64(width))))
            width *= 2
        key = (h & ~_LOW) | (_LOW - (rel.astype(np.uint64) & _LOW))
        m = _sliding(key, window, np.minimum)
        ok = (rel[: len(m)] >= GEAR - 1) & (row[: len(m)] == row[window - 1 :])
        m[~ok] = 0
        m = np.concatenate((np.zeros(window - 1, np.uint64), m, np.zeros(window - 1, np.uint64)))
        cuts = np.flatnonzero(_sliding(m, window, np.maximum)[:n] == key)
        stop = np.searchsorted(cuts, cuts + least)
        there = stop < len(cuts)
        a, b = cuts[there], cuts[stop[there]]
        same = row[a] == row[b]
        a, b = a[same], b[same]
        power = np.full(n, _B)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.cumsum(g * power)
        back = np.full(n + 1, _B_INV)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        digest = mix(((sums[b] - sums[a]) * back[a + 1]) ^ ((b - a).astype(np.uint64) << np.uint64(48)))
    return digest, row[a], rel[a] + 1, b - a


def windows(cps: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all stretches of ``width`` code points."""
    n = len(cps)
    if n < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        g = mix(cps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        power = np.full(n, _B)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(g * power)))
        back = np.full(n - width + 1, _B_INV)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        return mix((sums[width:] - sums[:-width]) * back)
