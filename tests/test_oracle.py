"""Every registered query with a DuckDB twin must match it (sf0.001)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import digest

from conftest import SF_SMALL

NAMES = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_query_runs_rows_only(spark):
    for name, fn in E.queries().items():
        if name in E.oracle_sql():
            continue
        assert fn(spark, SF_SMALL).count() > 0, name


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "label" in df.columns
