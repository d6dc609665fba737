"""Every registered query against its SQL, over the smallest tables; queries without SQL run and give rows."""

import duckdb
import pandas as pd
import pytest

from sluice.plans.catalog import ORACLES, QUERIES
from sluice.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return ""
        try:
            return repr(float(v)) if not isinstance(v, bool | str) else str(v)
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["fit_score", "evidence_pairs", "name_candidates_trigram", "due_sections"])
def test_plans_have_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scoring_stays_in_the_engine(spark):
    plan = QUERIES["fit_score"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
