"""Measuring the gate on planted candidates: parameter grid, weight schemes, reduced contracts."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import candidates, evaluation, gate, planted
from lacuna.plans.runtime import Scratch

# The settings that the published selection runs over, and the weights of the sensitivity test.
KEEPS = (0.70, 0.80, 0.90, 0.95)
REPEATS = (50, 100, 200)
STABILITIES = (0.70, 0.80, 0.90, 0.95)
SCHEMES = {
    "equal": {"provenance": 0.2, "specificity": 0.2, "path_diversity": 0.2, "stability": 0.2, "closure_clearance": 0.2},
    "provenance": {"provenance": 0.4, "specificity": 0.15, "path_diversity": 0.15, "stability": 0.15, "closure_clearance": 0.15},
    "path": {"provenance": 0.15, "specificity": 0.15, "path_diversity": 0.4, "stability": 0.15, "closure_clearance": 0.15},
    "specificity": {"provenance": 0.15, "specificity": 0.4, "path_diversity": 0.15, "stability": 0.15, "closure_clearance": 0.15},
}


def facts(spark: SparkSession, seeds: int, settings: gate.Settings = gate.Settings()) -> DataFrame:
    """What gate.decide needs of the planted candidates, with their labels and kinds."""
    t = planted.tables(spark, seeds)
    edges = Scratch(spark, "planted").save(t["edges"], "edges")
    return candidates.facts(edges, t["candidates"], t["docs"], settings, plausible=t["plausible"], aliases=t["aliases"], publications=t["publications"], end_year=planted.END_YEAR)


def grid(spark: SparkSession, seeds: int, keeps: tuple[float, ...] = KEEPS, repeats: tuple[int, ...] = REPEATS, stabilities: tuple[float, ...] = STABILITIES) -> DataFrame:
    """(keep, repeats, min_stability, tp, fp, fn, tn, precision, recall, f1) of every setting; facts are worked out once for a keep and repeats."""
    out = None
    for keep, n in product(keeps, repeats):
        s = gate.Settings(edge_keep=keep, paper_keep=keep, repeats=n)
        f = Scratch(spark, "grid").save(facts(spark, seeds, s), "facts")
        for least in stabilities:
            d = gate.decide(f, replace(s, min_stability=least)).select("label", (F.col("status") == "automatically_eligible").cast("int").alias("prediction"))
            row = evaluation.confusion(d).select(F.lit(keep).alias("keep"), F.lit(n).alias("repeats"), F.lit(least).alias("min_stability"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def schemes(f: DataFrame, k: int, weights: dict[str, dict[str, float]] = SCHEMES) -> DataFrame:
    """(scheme, precision_at_k, recall_at_k, ndcg_at_k, average_precision) of the evidence score under each set of weights."""
    out = None
    for name, w in weights.items():
        d = gate.decide(f, gate.Settings(weights=w)).select(F.lit(name).alias("scheme"), "label", F.col("ranking_score").alias("score"), F.col("candidate").alias("seq"))
        out = d if out is None else out.unionByName(d)
    return evaluation.ranking(out, ["scheme"], k)


def contracts(f: DataFrame) -> DataFrame:
    """(contract, tp, fp, fn, tn, precision, recall, f1) of every reduced contract."""
    x = evaluation.ablation_predictions(gate.decide(f))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("contract"), F.col(c).alias("prediction")) for c in evaluation.CONTRACTS])).alias("x")
    return evaluation.confusion(x.select("label", rows).select("label", "x.*"), "contract")
