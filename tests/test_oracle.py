"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from tessera.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    v = float(v) if isinstance(v, Decimal) else v
    return round(v, 6) + 0.0 if isinstance(v, float) and v == v else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    rows = duck.sql(ORACLE_SQL[name])
    assert sorted(rows.columns) == columns
    places = [rows.columns.index(c) for c in columns]
    assert got == Counter(tuple(value(r[i]) for i in places) for r in rows.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, SF).collect()
