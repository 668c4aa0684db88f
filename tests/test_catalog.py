"""Every registered query of the engine against its SQL twin."""

import math
import os

import duckdb
import pytest

from siltstone import catalog, roundtrips  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    want = sorted("|".join(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted("|".join(norm(r[c]) for c in cols) for r in rows) == want
