"""Every catalogue query against its SQL oracle in DuckDB, on the whole smallest data set."""

import pytest

import __spark_entry__ as contract
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
SLOW_ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    difference = compare(spark, duck, FOLDER, QUERIES[name], ORACLES[name])
    assert difference is None, difference


@pytest.mark.parametrize("name", SLOW_ROWS_ONLY)
def test_rows_without_oracle(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_cox_fit_figures(spark):
    """The covariates that have figures do not determine each other, and their intervals hold the coefficients."""
    rows = {r.feature: r for r in QUERIES["cox_fit"](spark, FOLDER).collect()}
    assert set(rows) == {"age", "volt", "rotate", "pressure", "vibration", "error_count", "maint_count"}
    assert [f for f in rows if rows[f].coef is None] == ["vibration"]
    for r in rows.values():
        assert r.coef is None or (r.coef_lower_95 < r.coef < r.coef_upper_95 and r.se > 0 and 0 <= r.p <= 1)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and {r["alert_level"] for r in rows} <= {"CRITIQUE", "HAUTE", "MOYENNE"}
