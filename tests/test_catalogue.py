"""Named queries against their check queries in DuckDB, on the small tables."""

import math
import numbers

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return "null"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        return repr(float(v)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_check(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
