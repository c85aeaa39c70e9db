"""How little a vantage-point tree over a whole collection prunes: python -m lacuna.llm.pruning PAPERS.parquet

Prints, for fingerprints of several lengths, the share of all distances that
queries at likeness 0.7 still have to compute.  A measurement, not an operator.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow.parquet as pq

from lacuna.llm import shingles as S
from lacuna.llm import vptree as V


def main(path: str, queries: int = 500) -> None:
    t = pq.read_table(path, columns=["title", "abstract"]).to_pydict()
    s, ends = S.shingle_sets([f"{a or ''} {b or ''}" for a, b in zip(t["title"], t["abstract"], strict=True)])
    n = np.diff(ends, prepend=0)
    rows = np.flatnonzero(n)
    reach = np.floor(0.3 / 0.7 * n[rows] + S.EPS).astype(np.int64)
    for words in (1, 2, 8, 32):
        fp = S.odd_sketch(s, ends, words)[rows]
        tree = V.Tree(fp)
        step = max(1, len(rows) // queries)
        tree.within(fp[::step], reach[::step])
        print(f"{64 * words} bits: {tree.visited / len(fp[::step]) / len(rows):.3f} of all distances, {len(rows)} rows")
    # The trees inside the shards, as near_duplicates builds them.
    counts = np.bincount(S.slot(s, 1 << 21), minlength=1 << 21)
    g, row, _, _ = S.ranked_prefixes(s, ends, counts, 0.7)
    fp = S.odd_sketch(s, ends)
    order = np.argsort(g, kind="stable")
    starts = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1]])
    shards = [x for x in np.split(row[order], starts[1:]) if len(x) > V.LEAF]
    done = every = 0
    for x in shards:
        tree = V.Tree(fp[x])
        tree.within(fp[x], np.floor(0.3 / 0.7 * n[x] + S.EPS).astype(np.int64))
        done, every = done + tree.visited, every + len(x) ** 2
    print(f"in shards: {len(starts)} shards, {len(shards)} above {V.LEAF} rows, the largest {max(map(len, shards), default=0)}; their trees compute {done} of {every} distances")


if __name__ == "__main__":
    main(sys.argv[1])
