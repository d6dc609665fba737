"""Queries against the whole job where their registered SQL has a cut: the cut is lifted here, the registered SQL stays as it is."""

import duckdb
import pytest

from sluice.plans.catalog import ORACLES, QUERIES
from sluice.sources.tables import TABLES
from tests.test_catalog import SF, rows


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["evidence_pairs", "resolve_decisions"])
def test_pairs_of_all_organisations(spark, con, name):
    cut = " WHERE gc_id % 10 < 3"
    assert ORACLES[name].count(cut) <= 1
    got = QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(con.execute(ORACLES[name].replace(cut, "")).df())
    gc = dict(con.execute("select o_orderkey, o_custkey from orders").fetchall())
    assert {gc[i] % 10 for i in got["c_id"]} == set(range(10))


def test_names_from_the_least_similarity_of_the_reference(spark, con):
    sql = ORACLES["name_candidates_trigram"]
    assert sql.endswith((">= 0.8", ">= 0.25"))
    got = QUERIES["name_candidates_trigram"](spark, SF).toPandas()
    assert rows(got) == rows(con.execute(sql.removesuffix("0.8").removesuffix("0.25") + "0.25").df())
    assert got["similarity"].min() < 0.8
