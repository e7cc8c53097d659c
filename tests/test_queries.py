"""Registered queries against their SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ("bm25_topk", "chunk_markdown", "chunk_fixed", "hybrid_rrf_topk", "ingest_plan", "eval_metrics", "dense_topk", "point_ids")


def cell(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = Counter(tuple(map(cell, r)) for r in frame.select(*columns).collect())
    want = Counter(tuple(map(cell, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert got == want and got


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
