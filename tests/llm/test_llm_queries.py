import pytest

from lacuna.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs_over_the_smallest_tables(spark, small, name):
    df = Q.queries()[name](spark, small)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_names():
    assert set(Q.oracle_sql()) <= set(Q.queries())
