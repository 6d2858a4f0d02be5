"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).columns == ["k", "ds", "y"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
