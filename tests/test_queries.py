"""Every registered query of the engine runs; those with SQL give DuckDB's rows."""

from __future__ import annotations

import os
from glob import glob

import duckdb
import pandas as pd
import pytest

from chronoloom.plans import queries as plans
from tests.conftest import DATA

SLOW = {n for n in plans.QUERIES if n.startswith(("forecast_", "probabilistic_", "cluster_"))}


def normal(table: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return float(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
            return float(v)
        return pd.Timestamp(v).isoformat() if hasattr(v, "year") else str(v)

    columns = sorted(table.columns)
    return table[columns].map(cell).sort_values(columns).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    mine, theirs = normal(plans.QUERIES[name](spark, DATA).toPandas()), normal(duck.execute(plans.ORACLES[name]).df())
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False, rtol=1e-9, atol=1.1e-4)


@pytest.mark.parametrize("name", sorted(SLOW - {"forecast_by_class"}))
def test_forecasts_and_clusters(spark, name):
    table = plans.QUERIES[name](spark, DATA).toPandas()
    assert len(table)
    if "predictions" in table:
        if "error" in table:
            assert table["error"].isna().all(), table["error"].dropna().iloc[0]
        assert table["predictions"].notna().all()
    if "lower_quantile_0.25" in table:
        assert (table["lower_quantile_0.25"] <= table["upper_quantile_0.75"]).all()


def test_all_have_oracles_or_cannot():
    without = set(plans.QUERIES) - set(plans.ORACLES)
    assert without <= SLOW | {"hier_reconcile_var", "hier_reconcile_cov", "regressor_estimator_interval", "outlier_isolation_forest", "outlier_corrected"}
