"""Every query of the catalogue against DuckDB on the same files, or for rows where SQL has none."""

import os
import subprocess
import sys

import duckdb
import pytest
from tessera.plans.queries import ORACLES, QUERIES

import __spark_entry__


def plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    return None if v is None or v != v else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    rows = df.toPandas()[names]
    if name not in ORACLES:
        assert len(rows) > 0
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(want.columns) == names
    key = lambda d: sorted(repr([plain(v) for v in r]) for r in d[names].astype(object).values.tolist())
    assert key(rows) == key(want)


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["chunk_id", "document_id", "chunk_index", "content", "score"] and got.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("first", ["chunk_queries", "engine_queries", "file_queries", "queries"])
def test_a_worker_may_import_any_part_first(first):
    code = f"import tessera.plans.{first}; from tessera.plans.queries import QUERIES; assert len(QUERIES) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(__spark_entry__.__file__))
