"""Every registered query against its SQL on an independent engine, over the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from loomrec import flow_queries, oracles, queries, record_queries


QUERIES = queries.QUERIES | record_queries.QUERIES | flow_queries.QUERIES
ORACLES = oracles.ORACLES | record_queries.ORACLES | flow_queries.ORACLES


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object).where(df[cols].notna(), None)
    rows = [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in map(_bare, r)) for r in df.itertuples(index=False)]
    return cols, sorted(rows, key=repr)


def _bare(v):
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, engine, name):
    assert plain(QUERIES[name](spark, sf_dir).toPandas()) == plain(engine.sql(ORACLES[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
