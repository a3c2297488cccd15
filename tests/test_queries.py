"""Every graph query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from graphloom.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(values):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rows(tuple(r[c] for c in columns) for r in df.collect())
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    assert got == rows(expected.select(*columns).fetchall())
    assert got or name == "path_none"
