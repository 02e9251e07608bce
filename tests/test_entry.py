"""Driver contract: entry, registry consistency, and a pass over every query at sf0.001."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"series_id", "zone", "start", "end", "duration_hrs", "load_mw"} <= set(df.columns)


def test_registry():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_every_query_runs_small(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SF)
        assert df.columns, name
        df.limit(5).collect()
