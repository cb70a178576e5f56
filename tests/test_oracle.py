"""Every registered query against its DuckDB oracle (the driver's check)."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from ledgerlake.plans import catalog
from ledgerlake.testing import compare, duck_connection

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck_connection(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, con, key):
    rows, problems = compare(QUERIES[key](spark, SMALL), con, ORACLES[key])
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["supplier_id", "supplier_name"]


@pytest.mark.parametrize("key", ["apply_defaults", "upsert_stamp", "apply_schema", "extract_incremental",
                                 "target_tracker", "f_to_date"])
def test_results_do_not_depend_on_session_time_zone(spark, con, key):
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows, problems = compare(QUERIES[key](spark, SMALL), con, ORACLES[key])
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    assert not problems, problems
