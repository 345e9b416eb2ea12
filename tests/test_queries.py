"""Every registered query against its SQL on the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import check
from rulegauge.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.sql("SET TimeZone = 'UTC'")
    for t in check.TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    made = []

    def run(*args):
        made.append(QUERIES[name](*args))
        return made[-1]
    said, _, fine = check.compare(spark, con, name, run, ORACLES.get(name), SF)
    assert fine, said
    plan = made[-1]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["top_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "PushedFilters" in plan
