"""The driver contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_names_and_sql():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 150 and all(map(callable, q.values()))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ticker", "date", "ret_1d", "ret_5d", "ret_21d", "ret_63d", "ret_252d"] and df.limit(1).count() == 1
