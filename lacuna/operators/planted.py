"""Candidates with a known answer, to measure the gate.

A kind of candidate is a row of properties below.  ``tables`` lays every kind out
once a seed, each with nodes of its own, so that one graph holds them all.  Of
the sixteen kinds four are sound; each other one breaks one rule of the gate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINK, CLUSTER, DECAY = "missing_link", "orphan_cluster", "temporal_decay"


@dataclass(frozen=True)
class Kind:
    """One kind of candidate.

    names: both ends, or what the members or the concept are called.  routes:
    two-edge paths between the ends.  papers: whether each edge has its own
    ('each'), all routes share one on their first edge ('shared'), or all edges
    have the same ('one').  observed: the ends are linked already.  supplied:
    edges that a search brings.  aliases: other names of both ends.  papers_of:
    the papers of each year at a concept.
    """

    family: str
    names: tuple[str, ...]
    sound: bool = False
    routes: int = 2
    papers: str = "each"
    observed: bool = False
    supplied: int = 0
    aliases: tuple[str, ...] = ()
    papers_of: dict[int, int] = field(default_factory=dict)
    peak: int | None = None


_ENDS = ("tidal sediment transport", "mangrove root density")
KINDS: dict[str, Kind] = {
    # Links: two good ones, one of them of short names, then one for every way to fail.
    "two routes": Kind(LINK, _ENDS, sound=True),
    "short names": Kind(LINK, ("pH", "CO2"), sound=True),
    "linked already": Kind(LINK, _ENDS, observed=True),
    "names of nothing": Kind(LINK, ("our approach", "technique")),
    "one route": Kind(LINK, _ENDS, routes=1),
    "routes of one paper": Kind(LINK, _ENDS, papers="shared"),
    "search finds the link": Kind(LINK, _ENDS, supplied=1),
    "known by other names": Kind(LINK, _ENDS, aliases=("estuary silt drift", "mangal rhizosphere cover")),
    "known with type words": Kind(LINK, ("Lidar [TOOL]", "Kelp2 [CONCEPT]")),
    "one thing twice": Kind(LINK, ("Turbidity [FINDING]", "turbidity [METRIC]")),
    # Clusters of six members, all linked to one another, and one edge outwards.
    "apart": Kind(CLUSTER, ("salt marsh accretion",), sound=True),
    "apart in one study": Kind(CLUSTER, ("salt marsh accretion",), papers="one"),
    "search bridges it": Kind(CLUSTER, ("salt marsh accretion",), supplied=6),
    # Concepts against PUBLICATIONS: a falling share, an equal share of fewer papers, a fall in the unfinished year alone.
    "share falls": Kind(DECAY, ("buoy drift telemetry",), sound=True, papers_of={2017: 8, 2018: 8, 2019: 2, 2020: 2}, peak=2017),
    "papers fall, share stays": Kind(DECAY, ("buoy drift telemetry",), papers_of={2017: 8, 2018: 8, 2019: 4, 2020: 4}, peak=2017),
    "last year unfinished": Kind(DECAY, ("buoy drift telemetry",), papers_of={2017: 8, 2018: 8, 2019: 4, 2020: 4, 2021: 1}, peak=2020),
}
PUBLICATIONS = {2017: 40, 2018: 40, 2019: 20, 2020: 20, 2021: 60}
END_YEAR = 2020
MEMBERS = 6
DOCUMENTS = ((2021, "estuary silt drift seen beside mangal rhizosphere cover"), (2021, "lidar surveys of kelp2 beds"))


def _edges(kind: Kind) -> list[tuple[str, str, str, int]]:
    """(u, v, paper, year) of a kind."""
    if kind.family == LINK:
        head, tail = kind.names
        first = (lambda r: "both") if kind.papers == "shared" else (lambda r: f"in {r}")
        out = [e for r in range(kind.routes) for e in ((head, f"mid {r}", first(r), 2018), (f"mid {r}", tail, f"out {r}", 2020))]
        return out + ([(head, tail, "direct", 2020)] if kind.observed else [])
    if kind.family == CLUSTER:
        m = _members(kind)
        pairs = [(a, b) for i, a in enumerate(m) for b in m[i + 1 :]]
        paper = (lambda n: "study") if kind.papers == "one" else (lambda n: f"paper {n}")
        return [(a, b, paper(n), 2019) for n, (a, b) in enumerate(pairs)] + [(m[0], "elsewhere", "crossing", 2019)]
    return [(kind.names[0], f"topic {year} {n}", f"paper {year} {n}", year) for year, count in kind.papers_of.items() for n in range(count)]


def _members(kind: Kind) -> list[str]:
    return [f"{kind.names[0]} {i}" for i in range(MEMBERS)]


def _supplied(kind: Kind) -> list[tuple[str, str]]:
    if kind.family == LINK:
        return [(kind.names[1], kind.names[0])] * kind.supplied
    return [(m, f"far {i}") for i, m in enumerate(_members(kind)[: kind.supplied])]


def tables(spark: SparkSession, seeds: int) -> dict[str, DataFrame]:
    """edges, candidates (with label and kind), plausible, aliases, publications and docs for candidates.facts, ``seeds`` times.

    The templates are a fixed number of rows; they are laid beside the seeds.
    """
    seed = spark.range(seeds).select(F.col("id").cast("string").alias("seed"))

    def laid(rows: list[tuple], schema: str) -> DataFrame:
        return seed.join(F.broadcast(spark.createDataFrame(rows, f"kind string, {schema}")), F.lit(True)).withColumn("case", F.concat_ws("-", "seed", "kind"))

    at = lambda c: F.concat_ws("/", "case", c)
    edges = laid([(k, n, *e) for k, kind in KINDS.items() for n, e in enumerate(_edges(kind))], "no int, u string, v string, paper string, year int")
    edges = edges.select(F.xxhash64("case", "no").alias("edge_seq"), at("u").alias("u"), at("v").alias("v"), F.lit("USES").alias("relation"), at("paper").alias("source_paper"), "year", F.lit("").alias("evidence"))
    told = [(k, d.family, *(d.names if d.family == LINK else (None, None)), d.names[0] if d.family == DECAY else None, _members(d) if d.family == CLUSTER else None, _members(d) if d.family == CLUSTER else [n.split(" [")[0] for n in d.names], d.peak, int(d.sound)) for k, d in KINDS.items()]
    c = laid(told, "family string, head string, tail string, concept string, members array<string>, entities array<string>, peak_year int, label int")
    named = lambda col: F.when(F.col(col).isNotNull(), at(col)).alias(col)
    score = lambda family, value: F.when(F.col("family") == family, F.lit(value))
    c = c.select(
        F.col("case").alias("candidate"), "family", named("head"), named("tail"), named("concept"), score(CLUSTER, "").alias("none"), "case", "entities", "peak_year", "label", "kind",
        F.transform("members", lambda m: F.concat_ws("/", "case", m)).alias("members"), score(LINK, 5.0).alias("prediction_score"), score(CLUSTER, 0.06).alias("inter_edge_ratio"), score(DECAY, 0.5).alias("decay_rate"), F.lit(True).alias("search_performed"),
    )
    c = c.withColumn("community", F.when(F.col("none").isNotNull(), F.col("case"))).drop("none", "case")
    pool = laid([(k, str(n), *e) for k, kind in KINDS.items() for n, e in enumerate(_supplied(kind))], "item string, head string, tail string")
    pool = pool.select(F.col("case").alias("candidate"), "item", at("head").alias("head"), at("tail").alias("tail"), F.lit(None).cast("string").alias("paper"), F.lit(None).cast("int").alias("year"))
    aliases = laid([(k, n, a) for k, kind in KINDS.items() for n, a in enumerate(kind.aliases)], "entity_no int, label string").select(F.col("case").alias("candidate"), "entity_no", "label")
    return {
        "edges": edges,
        "candidates": c,
        "plausible": pool,
        "aliases": aliases,
        "publications": spark.createDataFrame(list(PUBLICATIONS.items()), "year int, publications bigint"),
        "docs": spark.createDataFrame([(str(n), *d) for n, d in enumerate(DOCUMENTS)], "doc string, year int, text string"),
    }
