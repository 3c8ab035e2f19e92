"""Each query of the engine against DuckDB on the smallest test data."""

import os

import duckdb
import pandas as pd
import pytest

from tracklight.oracle import ORACLE_SQL
from tracklight.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)[:10] if hasattr(x, "year") else str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(repr, map(plain, r))) for r in df[names].itertuples(index=False))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, SF_DIR).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_handover_is_whole_and_the_same_twice(spark):
    first, second = ([r.line for r in QUERIES["handover_note"](spark, SF_DIR).collect()] for _ in range(2))
    assert first == second
    assert first[0] == "# Shift handover"
    heads = [x for x in first if x.startswith("## ")]
    assert heads == ["## Open incidents", "## Changed in the last 60h", "## Response/resolution targets at risk", "## Blocked"]
