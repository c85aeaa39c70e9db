"""The aggregates behind figures, run statistics and the workbench."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels that are never drawn.
BAD_LABELS = ("proposed method", "our method", "the model", "this paper", "our approach", "the proposed method", "this work", "our framework", "proposed approach", "method")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal-width bins over the column's range; nulls are left out, empty bins are not listed."""
    b = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")).join(F.broadcast(b))  # b: one row
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    g = x.groupBy(place.alias("bin"), "lo", width.alias("width")).agg(F.count("*").alias("n"))
    return g.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), "n")


def family_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("family").agg(F.count("*").alias("candidates"))


def filtered(candidates: DataFrame, families: tuple[str, ...], most: int = 30) -> DataFrame:
    """The best ``most`` of the chosen families by rank."""
    return candidates.where(F.col("family").isin(*families)).orderBy("rank").limit(most)


def drawn_nodes(centrality: DataFrame, gap_nodes: DataFrame, least: float = 0.04, length: int = 24) -> DataFrame:
    """(node, label, is_gap): the nodes that a figure names."""
    x = centrality.join(gap_nodes.select("node").distinct().withColumn("is_gap", F.lit(True)), "node", "left").withColumn("is_gap", F.coalesce("is_gap", F.lit(False)))
    x = x.where(((F.col("centrality") > least) | F.col("is_gap")) & ~F.lower("node").isin(*BAD_LABELS))
    return x.select("node", F.substring("node", 1, length).alias("label"), "is_gap")


def run_stats(collected: DataFrame, retained: DataFrame, triples: DataFrame, outputs: DataFrame) -> DataFrame:
    """(measure, value) of a run: papers collected and retained, triples, outputs and those with text."""
    parts = [df.agg(F.lit(name).alias("measure"), F.count("*").alias("value")) for name, df in (("collected", collected), ("retained", retained), ("triples", triples), ("outputs", outputs), ("outputs_with_text", outputs.where("coalesce(trim(text), '') != ''")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matched_outputs(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's rows beside b's of the same paper, or, where a paper has none, of the same position.

    Both have (position, paper_id, text).
    """
    by_id = b.select("paper_id", F.col("text").alias("by_id")).where("paper_id is not null").dropDuplicates(["paper_id"])
    by_place = b.select("position", F.col("text").alias("by_place")).dropDuplicates(["position"])
    return a.join(by_id, "paper_id", "left").join(by_place, "position", "left").select("position", "paper_id", "text", F.coalesce("by_id", "by_place").alias("other"))


def top(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n rows of the highest value, ties by name."""
    return df.orderBy(F.desc(by), tie).limit(n)
