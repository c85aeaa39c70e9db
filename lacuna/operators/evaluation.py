"""Evaluation: classification and ranking metrics, reviews, samples, method comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.draws import uniform
from lacuna.functions.text import words
from lacuna.plans.runtime import ranked

DECISIONS = ("Accept", "Modify", "Reject", "Pending")
CONTRACTS = ("provenance_only", "specificity_only", "path_diversity_only", "perturbation_only", "hard_contract_without_perturbation", "full_without_coverage_screen", "full_evidence_contract")
FAMILIES = ("missing_link", "orphan_cluster", "temporal_decay")
STATUSES = ("review_required", "rejected", "automatically_eligible")


def confusion(df: DataFrame, *by: str) -> DataFrame:
    """(by..., tp, fp, fn, tn, precision, recall, f1) of (label, prediction), zero-safe."""
    n = lambda y, p: F.count_if((F.col("label") == y) & (F.col("prediction") == p))
    x = df.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    x = x.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return x.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def mean_f1(per_seed: DataFrame) -> DataFrame:
    """One row: mean F1 over seeds with its 95 % interval, clipped to 0..1."""
    half = F.coalesce(1.96 * F.stddev_samp("f1") / F.sqrt(F.count("*").cast("double")), F.lit(0.0))
    x = per_seed.agg(F.avg("f1").alias("mean_f1"), half.alias("half"))
    return x.select("mean_f1", F.greatest(F.col("mean_f1") - F.col("half"), F.lit(0.0)).alias("low"), F.least(F.col("mean_f1") + F.col("half"), F.lit(1.0)).alias("high"))


def ranking(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by..., precision_at_k, recall_at_k, ndcg_at_k, average_precision) of (label, score, seq) in each group.

    By score descending, ties by seq.  k is cut to the group's size.  A group is
    ranked in one window, so groups are evaluation sets, not a corpus.
    """
    w = Window.partitionBy(*by)
    order = w.orderBy(F.desc("score"), "seq")
    x = df.select(*by, "label", "score", "seq", F.row_number().over(order).alias("r"), F.sum("label").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"), F.row_number().over(w.orderBy(F.desc("label"), "seq")).alias("ideal"), F.count("*").over(w).alias("n"))
    top, gain = F.col("r") <= k, lambda r: F.col("label") / F.log2(F.col(r) + F.lit(1.0))
    g = x.groupBy(*by).agg(
        F.sum(F.when(top, F.col("label")).otherwise(0)).alias("found"), F.sum("label").alias("positives"), F.least(F.max("n"), F.lit(k)).alias("k"),
        F.sum(F.when(top, gain("r")).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("ideal") <= k, gain("ideal")).otherwise(0.0)).alias("idcg"), F.sum(F.when(F.col("label") == 1, F.col("hits") / F.col("r")).otherwise(0.0)).alias("ap"),
    )
    one = F.greatest("positives", F.lit(1))
    return g.select(*by, (F.col("found") / F.greatest("k", F.lit(1))).alias("precision_at_k"), (F.col("found") / one).alias("recall_at_k"), F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg_at_k"), (F.col("ap") / one).alias("average_precision"))


def best_setting(grid: DataFrame) -> DataFrame:
    """The grid row of the highest F1, then precision, recall, fewest repeats."""
    return grid.orderBy(F.desc("f1"), F.desc("precision"), F.desc("recall"), "repeats").limit(1)


def ablation_predictions(decisions: DataFrame, min_specificity: float = 0.55, min_stability: float = 0.70) -> DataFrame:
    """decisions with a 0/1 column for each reduced contract."""
    free = lambda *rs: ~F.arrays_overlap("reasons", F.array(*map(F.lit, rs)))
    hard = ("insufficient_independent_paper_support", "generic_or_underspecified_entities", "insufficient_source_disjoint_evidence_paths", "observed_relation_requires_qualified_review", "canonical_self_link")
    checks: dict[str, Column] = {
        "provenance_only": F.col("m_provenance") >= 1.0, "specificity_only": F.col("m_specificity") >= min_specificity, "path_diversity_only": F.col("m_path_diversity") >= 1.0, "perturbation_only": F.col("m_stability") >= min_stability,
        "hard_contract_without_perturbation": free(*hard), "full_without_coverage_screen": free(*hard, "unstable_under_multi_mode_perturbation"), "full_evidence_contract": F.col("status") == "automatically_eligible",
    }
    return decisions.withColumns({k: v.cast("int") for k, v in checks.items()})


def review_summary(reviews: DataFrame) -> DataFrame:
    """One row: decisions by kind, acceptance rate over decided ones, whether all are decided.

    reviews: (review_key, decision); a null decision is pending.
    """
    d = F.coalesce("decision", F.lit("Pending"))
    x = reviews.agg(*[F.count_if(d == k).alias(k.lower()) for k in DECISIONS], F.count("*").alias("total"))
    return x.withColumn("acceptance_rate", F.expr("try_divide(accept, accept + modify + reject)")).withColumn("complete", (F.col("pending") == 0) & (F.col("total") > 0))


def crosstab(decisions: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """(status, accept, modify, reject, pending): gate status by review decision, zero-filled, in fixed order."""
    x = decisions.select(key, "status").join(reviews.select(key, "decision"), key, "left").withColumn("decision", F.coalesce("decision", F.lit("Pending")))
    got = x.groupBy("status").agg(*[F.count_if(F.col("decision") == d).alias(d.lower()) for d in DECISIONS])
    rows = decisions.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return rows.join(got, "status", "left").na.fill(0)


def carry_reviews(candidates: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """candidates with the decision of an earlier review of the same identity, else 'Pending' (C20)."""
    return candidates.join(prior.select(key, "decision").dropDuplicates([key]), key, "left").withColumn("decision", F.coalesce("decision", F.lit("Pending")))


def queue_positions(decisions: DataFrame, order: tuple[str, ...] = ("automatically_eligible", "review_required", "rejected"), tie: str = "seq") -> DataFrame:
    """decisions with a position over the ordered categories."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    return ranked(decisions, rank, F.col(tie), name="position")


def review_ledger(queue: DataFrame, ranked_before: DataFrame, prior: DataFrame, tie: str = "candidate") -> DataFrame:
    """The queue after the gate, with the decisions that an earlier review of the same candidates made.

    queue: (candidate, family, ranking_score, reasons, papers, closure_hits);
    ranked_before: (candidate, rank) of the reviewed list; prior: (rank,
    decision).  Only a decided row of the very same candidate is carried over,
    all else is pending; nothing is filled in.  The order is by family, then by
    ``tie``.
    """
    x = queue.join(ranked_before.select("candidate", F.col("rank").alias("prior_rank")).dropDuplicates(["candidate"]), "candidate", "left")
    made = prior.where(F.col("decision").isin(*[k for k in DECISIONS if k != "Pending"])).select(F.col("rank").alias("prior_rank"), F.col("decision").alias("made")).dropDuplicates(["prior_rank"])
    x = x.join(made, "prior_rank", "left")
    source = F.when(F.col("made").isNotNull(), F.concat(F.lit("carried_from_rank_"), F.col("prior_rank").cast("string"))).otherwise("pending_author_review")
    family = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
    x = x.select(F.sha2("candidate", 256).alias("review_key"), "candidate", "family", F.coalesce("made", F.lit("Pending")).alias("decision"), source.alias("decision_source"), "prior_rank", "ranking_score", "reasons", "papers", "closure_hits")
    return ranked(x, family, F.col(tie), name="queue_position")


def stratified_sample(df: DataFrame, strata: list[str], size: int, key: str, seed: int = 42) -> DataFrame:
    """``size`` rows taken in turn from every stratum, in a fixed random order within each.

    Each stratum gives at most ``size`` rows, kept by Spark's window group limit.
    """
    draw = uniform(F.lit(seed), F.col(key))
    w = Window.partitionBy(*strata).orderBy("draw", key)
    x = df.withColumn("draw", draw).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= size)
    return x.orderBy("turn", *strata).limit(size).drop("draw")


def blinded_id(identity: Column, length: int = 10) -> Column:
    """A short id that tells nothing about its row."""
    return F.substring(F.sha2(identity, 256), 1, length)


def method_comparison(outputs: DataFrame) -> DataFrame:
    """(method, outputs, unique_outputs, mean_words, papers) of (method, paper_id, text)."""
    return outputs.groupBy("method").agg(F.count("*").alias("outputs"), F.count_distinct("text").alias("unique_outputs"), F.avg(F.size(words(F.col("text")))).alias("mean_words"), F.count_distinct("paper_id").alias("papers"))


def token_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: jaccard of two pools of (token), 0 for empty pools."""
    x = a.select("token").distinct().withColumn("in_a", F.lit(1)).join(b.select("token").distinct().withColumn("in_b", F.lit(1)), "token", "full")
    return x.agg(F.coalesce(F.expr("try_divide(count_if(in_a = 1 and in_b = 1), count(*))"), F.lit(0.0)).alias("jaccard"))
