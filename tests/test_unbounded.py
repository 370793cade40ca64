"""Searches whose ef is no less than the table: few steps, and the k nearest of all rows that can be reached."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.operators import search, unbounded
from shoal.plans import catalog
from tests.test_catalog import SF, rows
from tests.test_operators import found, table


def test_steps_grow_with_blocks_and_not_with_rows(spark, monkeypatch):
    monkeypatch.setattr(unbounded, "BLOCK_ROWS", 20)
    n = 60
    v = table(spark, [(i, [i, 0]) for i in range(n)])
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    q, seeds = table(spark, [(0, [50.2, 0]), (1, [-3, 0])], "query_id"), spark.createDataFrame([(0, 0), (1, 10)], "query_id long, vec_id long")
    assert found(search.supersteps(q, seeds, edges, v, 2, n, 1, most=4)) == [(0, 50), (0, 51), (1, 10), (1, 11)]
    with pytest.raises(RuntimeError, match="still open"):
        search.supersteps(q, seeds, edges, v, 2, n, 1, most=1)


@pytest.mark.parametrize("parts", [0, 3])
def test_all_rows_that_can_be_reached_and_no_others(spark, monkeypatch, parts):
    monkeypatch.setattr(unbounded, "BLOCK_ROWS", 9)
    monkeypatch.setattr(unbounded, "QUERY_ROWS", 30)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, (80, 3)).tolist()  # many ties
    x[5], x[6], x[7], x[8] = None, [1, 1], [0, None, 0], [float("nan"), 0, 0]  # can be passed through only
    ids = rng.permutation(1000)[:80].tolist()
    v = spark.createDataFrame([(ids[i], None if a is None else [None if c is None else float(c) for c in a]) for i, a in enumerate(x)], "vec_id long, embedding array<float>")
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 70, (110, 2))} | {(5, 75), (75, 76)}
    edges = spark.createDataFrame([(ids[a], ids[b]) for a, b in pairs] + [(ids[0], 5000), (5000, ids[79])], "src long, dst long")
    starts = rng.integers(0, 80, (100, 2)).tolist()
    q = table(spark, [(100 + i, rng.integers(0, 3, 3)) for i in range(100)], "query_id")
    seeds = spark.createDataFrame([(100 + i, ids[a]) for i, s in enumerate(starts) for a in s], "query_id long, vec_id long")
    owned = v.select("vec_id", (F.col("vec_id") % parts).alias("owner")) if parts else None
    leader = q.select("query_id", (F.col("query_id") % parts).alias("leader")) if parts else None
    got = [(r["query_id"], r["vec_id"], r["dist"]) for r in search.supersteps(q, seeds, edges, v, 4, 80, owned=owned, leader=leader).orderBy("query_id", "rank").collect()]
    want = []
    for r in q.orderBy("query_id").collect():
        met, todo = set(), list(starts[r["query_id"] - 100])
        while todo:
            a = todo.pop()
            if a not in met:
                met.add(a)
                todo += [b for s, b in pairs if s == a]
        near = sorted((sum((p - c) ** 2 for p, c in zip(x[a], r["embedding"])), ids[a]) for a in met if a not in (5, 6, 7, 8))
        want += [(r["query_id"], i, d) for d, i in near[:4]]
    assert got == want


@pytest.mark.parametrize("name", ["ann_global_pull", "ann_collaborative"])
def test_registered_searches_match_their_sql(spark, monkeypatch, name):
    monkeypatch.setattr(unbounded, "BLOCK_ROWS", 150)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        want = rows(db.execute(catalog.oracle_sql()[name]).df())
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == want
