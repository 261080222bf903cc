"""Every query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from foliospark import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(v) if isinstance(v, float) else v


def bag(rows):
    return sorted(repr(tuple(plain(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert bag(df.collect()) == bag([r[i] for i in at] for r in rel.fetchall())


def test_position_rings_run_over_every_embedding(spark):
    rows = catalog.queries()["position_rings"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert all(r.distance.count(',') == 63 for r in rows)


def test_entry_without_the_training_data_operators():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
