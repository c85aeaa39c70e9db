import math

import duckdb
import pytest

from lacuna import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings papers triples screenings withdrawals name_matches source_targets".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_oracle(spark, small, oracle, name):
    df = catalog.queries()[name](spark, small)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name not in catalog.oracle_sql():
        return
    cur = oracle.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([plain(r[cols.index(c)]) for c in df.columns]) for r in cur.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in rows) == want


def test_the_llm_subpackage_is_optional():
    import ast
    from pathlib import Path

    root = Path(catalog.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("lacuna.llm") for n in names), p
