"""Every query with SQL gives DuckDB's rows."""

from __future__ import annotations

import pandas as pd
import pytest

from latentia.plans import catalogue, model_oracles as oracles
from tests.conftest import SMALL


def plain(df: pd.DataFrame) -> list[tuple]:
    one = lambda x: None if x is None or x != x else x if isinstance(x, str) else float(x)
    rows = [tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x) if isinstance(x, str) else "", x if isinstance(x, float) else 0.0) for x in r))


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SMALL).toPandas(), duck.execute(oracles.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_all_queries_with_sql_exist():
    assert set(oracles.SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
