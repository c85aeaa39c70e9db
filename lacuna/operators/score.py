"""Scores and ranks of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.plans.runtime import ranked

WEIGHTS = {"centrality": 0.15, "cluster_isolation": 0.25, "temporal_decay": 0.25, "prediction_confidence": 0.25, "validation": 0.35}


def metric_columns(df: DataFrame) -> DataFrame:
    """df with the five metrics, null where one does not apply to the family.

    df: (family, prediction_score, inter_edge_ratio, decay_rate, mean_centrality, ranking_score).
    """
    fam = F.col("family")
    return df.withColumns(
        {
            "prediction_confidence": F.when(fam == "missing_link", F.least(F.abs("prediction_score") / 10.0, F.lit(1.0))),
            "centrality": F.coalesce("mean_centrality", F.lit(0.0)),
            "cluster_isolation": F.when(fam == "orphan_cluster", 1 - F.col("inter_edge_ratio")),
            "temporal_decay": F.when(fam == "temporal_decay", F.col("decay_rate")),
            "validation": F.col("ranking_score"),
        }
    )


def composite(weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean over the metrics that apply; 0 without any weight."""
    top = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    low = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    return F.when(low > 0, top / low).otherwise(F.lit(0.0))


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the column scaled to 0..1; all 0 where all values are equal (Q10)."""
    b = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    spread = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    return df.join(F.broadcast(b)).withColumn(out, (F.col(column) - F.col("lo")) / spread).drop("lo", "hi")  # b: one row


def rank_candidates(df: DataFrame, top_k: int | None = None, weights: dict[str, float] = WEIGHTS, tie: str = "seq") -> DataFrame:
    """df with raw_composite_score, composite_score (scaled) and rank; ties by ``tie``.

    With top_k only those rows are ranked, and Spark keeps top_k rows a task;
    without it the ranks come from a global sort.
    """
    x = min_max(metric_columns(df).withColumn("raw_composite_score", composite(weights)), "raw_composite_score", "composite_score")
    order = (F.desc("raw_composite_score"), F.col(tie))
    if top_k is None:
        return ranked(x, *order)
    return x.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # top_k rows


def ablation(candidates: DataFrame) -> DataFrame:
    """(configuration, gaps): the number of candidates of every combination of the three families."""
    n = candidates.agg(*[F.count_if(F.col("family") == f).alias(c) for f, c in (("missing_link", "ml"), ("orphan_cluster", "oc"), ("temporal_decay", "td"))])
    rows = (("TransE only", "ml"), ("Louvain only", "oc"), ("Temporal decay only", "td"), ("TransE + Louvain", "ml + oc"), ("TransE + Decay", "ml + td"), ("Louvain + Decay", "oc + td"), ("All three (full)", "ml + oc + td"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(name).alias("configuration"), F.expr(e).alias("gaps")) for name, e in rows])).alias("x")).select("x.*")
