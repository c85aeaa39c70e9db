"""The gate on planted candidates: sixteen kinds a seed, four of them sound."""

import pytest
from pyspark.sql import functions as F

from lacuna.operators import evaluation, gate, planted
from lacuna.plans import benchmark

SEEDS = 4


@pytest.fixture(scope="module")
def facts(spark):
    return benchmark.Scratch(spark, "facts").save(benchmark.facts(spark, SEEDS), "facts")


def test_only_sound_candidates_pass(facts):
    rows = gate.decide(facts).select("kind", "label", "status", "reasons").collect()
    wrong = [r for r in rows if (r["status"] == "automatically_eligible") != bool(r["label"])]
    assert len(planted.KINDS) == 16 and len(rows) == 16 * SEEDS and not wrong, wrong[:3]
    reasons = {}
    for r in rows:
        reasons.setdefault(r["kind"], set()).update(r["reasons"])
    assert "possible_prior_coverage_found_in_local_corpus" in reasons["known by other names"] & reasons["known with type words"]
    assert "canonical_self_link" in reasons["one thing twice"] and "generic_or_underspecified_entities" in reasons["names of nothing"]
    assert "insufficient_source_disjoint_evidence_paths" in reasons["one route"] & reasons["routes of one paper"]
    assert "observed_relation_requires_qualified_review" in reasons["linked already"]
    assert "insufficient_independent_paper_support" in reasons["apart in one study"]
    assert all("unstable_under_multi_mode_perturbation" in reasons[k] for k in ("search finds the link", "search bridges it", "papers fall, share stays", "last year unfinished"))


def test_reduced_contracts_let_more_through(facts):
    got = {r["contract"]: (r["tp"], r["fp"], r["fn"], r["f1"]) for r in benchmark.contracts(facts).collect()}
    assert got["full_evidence_contract"] == (4 * SEEDS, 0, 0, 1.0)
    assert got["full_without_coverage_screen"][:3] == (4 * SEEDS, 2 * SEEDS, 0)  # the two that coverage finds
    assert got["provenance_only"][1] > got["perturbation_only"][1] > got["full_without_coverage_screen"][1]


def test_grid_and_best_setting(spark):
    grid = benchmark.grid(spark, 2, keeps=(0.7, 0.95), repeats=(50,), stabilities=(0.7, 0.95)).cache()
    rows = {(r["keep"], r["min_stability"]): r["f1"] for r in grid.collect()}
    assert len(rows) == 4 and rows[(0.95, 0.7)] == 1.0 and rows[(0.7, 0.95)] < 1.0
    best = evaluation.best_setting(grid).first()
    assert (best["keep"], best["min_stability"], best["f1"]) == (0.95, 0.7, 1.0)


def test_weight_schemes(facts):
    got = {r["scheme"]: r["average_precision"] for r in benchmark.schemes(facts, 4 * SEEDS).collect()}
    assert set(got) == set(benchmark.SCHEMES) and all(0.4 < v <= 1.0 for v in got.values()) and got["specificity"] <= got["equal"]


def test_no_seed_gives_empty_tables(spark):
    t = planted.tables(spark, 0)
    assert t["edges"].isEmpty() and t["candidates"].isEmpty() and t["candidates"].select(F.col("members")).columns == ["members"]
