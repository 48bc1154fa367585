"""The driver's contract."""

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["high"] + r["medium"] + r["low"] == r["total_users"] for r in rows)
