"""Connected components of pairwise links by randomised contraction.

In each round every vertex hooks to the neighbour (or itself) that comes first
in a fresh hash order, the links are relabelled by these representatives and
deduplicated, and loops fall away.  A round removes a constant share of the
vertices whatever the shape, so long chains need no more rounds than stars.
The rounds' mappings are then composed, last to first.

Hubs: finding the representatives pre-aggregates before it shuffles, so a hub's
links meet as one row a task.  Relabelling joins links with one row a vertex;
the side of a hub's links is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.plans.runtime import Scratch

MAX_ROUNDS = 200


def connected_components(links: DataFrame, a: str, b: str, node: str = "node", group: str = "component", seed: int = 17) -> DataFrame:
    """(node, group): every vertex that is linked to another one, with the smallest vertex of its group.

    Rows with a null side and links of a vertex to itself count for nothing;
    repeated and reversed links count once; other columns are not read.  No link
    at all gives an empty result.  Vertices may be of any orderable type; text
    compares by bytes.
    """
    scratch = Scratch(links.sparkSession, "components")
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    edges = scratch.save(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    maps: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(seed + turn), F.col(c)).alias("h"), F.col(c).alias("to"))
        both = edges.select("u", order("v").alias("o")).unionAll(edges.select(F.col("v").alias("u"), order("u").alias("o")))
        hooks = both.groupBy("u").agg(F.min("o").alias("o")).select(F.col("u").alias("at"), F.least("o", order("u"))["to"].alias("to"))
        hooks = scratch.save(hooks, f"hooks{turn}")
        left = edges.join(hooks.select(F.col("at").alias("u"), F.col("to").alias("x")), "u")
        both = left.join(hooks.select(F.col("at").alias("v"), F.col("to").alias("y")), "v").where("x != y")
        after = scratch.save(both.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), f"links{turn}")
        scratch.drop(edges)
        edges = after
        maps.append(hooks)
    else:
        raise RuntimeError(f"links are left after {MAX_ROUNDS} rounds")
    if not maps:
        return edges.select(F.col("u").alias(node), F.col("v").alias(group))
    # What the last round maps to is final; each earlier round's targets are looked up in the rounds after it.
    final = maps[-1]
    for hooks in reversed(maps[:-1]):
        later = final.select(F.col("at").alias("to"), F.col("to").alias("end"))
        grown = scratch.save(hooks.join(later, "to", "left").select("at", F.coalesce("end", "to").alias("to")), "expanded")
        scratch.drop(final)
        final = grown
    names = final.groupBy("to").agg(F.min("at").alias(group))
    return final.join(names, "to").select(F.col("at").alias(node), group)
