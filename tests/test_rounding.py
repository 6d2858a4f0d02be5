"""Rounded doubles are SQL's to the last digit, ties included."""

from __future__ import annotations

import duckdb
import pytest

from chronoloom.plans import queries as plans

EVENTS = "/root/testdata/sf0.01/events.parquet"


def test_rounded_as_in_sql(spark):
    values = [46.56625, -46.56625, 31.12375, 46.94725, 0.00005, 2.5, -0.00004, 1e300, -1e306, 123456.00005, float("inf"), None]
    spark.createDataFrame([(x,) for x in values], "y double").createOrReplaceTempView("rounding")
    mine = [r[0] for r in spark.table("rounding").select(plans._rounded("y", 4)).collect()]
    assert mine == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 4)", [x]).fetchone()[0] for x in values]


@pytest.mark.parametrize("name", ["interpolate_backward", "interpolate_both", "interpolate_inside"])
def test_means_that_are_ties(spark, name):
    """Three means of this table print as ties."""
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{EVENTS}'")
    mine = {(r.k, r.ds): r.y for r in plans.QUERIES[name](spark, EVENTS.rsplit("/", 1)[0]).collect()}
    assert mine == {(k, ds): y for k, ds, y in duck.execute(plans.ORACLES[name]).fetchall()}


@pytest.fixture(scope="module")
def ties(tmp_path_factory) -> str:
    """Series whose filled values print as ties, between two values and beside them. A day has one row, so no sum depends on an order."""
    folder = tmp_path_factory.mktemp("ties")
    values = "(0, NULL), (2, k * 1.13e0 + k % 2 * 0.00125e0), (10, k * 0.72e0 + 0.01e0 + k % 2 * 0.00125e0), (12, NULL)"
    duckdb.execute(f"COPY (SELECT k AS user_id, TIMESTAMP '2024-01-01' + to_days(d) AS ts, y AS value FROM range(400) r(k), LATERAL (VALUES {values}) v(d, y)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["interpolate_both", "interpolate_inside"])
def test_filled_values_that_are_ties(spark, ties, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{ties}/events.parquet'")
    mine = {(r.k, r.ds): r.y for r in plans.QUERIES[name](spark, ties).collect()}
    theirs = {(k, ds): y for k, ds, y in duck.execute(plans.ORACLES[name]).fetchall()}
    assert mine.keys() == theirs.keys() and {at: (y, theirs[at]) for at, y in mine.items() if y != theirs[at]} == {}
