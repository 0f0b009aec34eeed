"""Queries with an oracle statement, against DuckDB on the smallest data set.

By default: staging, marts, single operators and the first report of each mart. Set
ALL_QUERIES=1 for all of them, or run ``python tests/compare.py <sf_dir>``.
"""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()
CHOSEN = sorted(n for n in ORACLE if os.environ.get("ALL_QUERIES") or n.startswith(("stg_", "mart_", "prim_"))
                or (n.startswith("rpt_") and n.endswith("_1")))


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, sf_dir, con, name):
    assert compare(entry.queries()[name](spark, sf_dir), con, ORACLE[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert "rfm_segment" in df.columns and df.count() > 0
