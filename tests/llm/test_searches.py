import math

import numpy as np
import pytest

from shoal.llm.covertree import cover_tree, dual_search, exact_top_k, leaves
from shoal.llm.partitions import approximate_top_k, balanced_parts, neighbours


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, block int")


def brute(x, ids, i, k, scale=None):
    x = np.floor(64 * x) if scale else x
    s = x @ x[i]
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
    return [(int(ids[j]), s[j]) for j in order]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(12, 16))
    x = (c[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 16))).astype(np.float32).astype(float)
    x[500:560] = x[20]  # one vector, many times
    return np.arange(900), x


def test_exact(spark, clustered):
    ids, x = clustered
    got = {}
    for r in exact_top_k(table(spark, [(int(i), v.tolist(), 0, "x", 1) for i, v in zip(ids, x)])).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == [i for i in range(900) if i % 20 == 0]
    for q, ranks in got.items():
        assert [ranks[k] for k in range(1, 21)] == [(v, int(s)) for v, s in brute(x, ids, q, 20, 64)]


@pytest.mark.parametrize("leaf", [4, 64])
def test_trees_cover_and_prune_right(clustered, leaf):
    ids, x = clustered
    tree, todo = cover_tree(x, leaf), []
    todo.append(tree)
    while todo:
        n = todo.pop()
        assert np.sqrt(((x[n.rows] - n.center) ** 2).sum(1)).max() <= n.radius + 1e-9
        if n.children:
            assert sorted(np.concatenate([c.rows for c in n.children]).tolist()) == sorted(n.rows.tolist())
        todo += n.children
    assert sum(len(n.rows) for n in leaves(tree)) == len(x)
    z = np.floor(64 * x)
    q, d, s = dual_search(ids[::50], z[::50], ids, z, 5, leaf)
    for k in range(0, len(ids[::50])):
        assert [(int(ids[j]), float(v)) for j, v in zip(d[q == k], s[q == k])] == [(a, float(b)) for a, b in brute(x, ids, 50 * k, 5, 64)]


def test_pairs_of_nodes_are_pruned(clustered):
    ids, x = clustered
    z, counts = np.floor(64 * x), {"opened": 0, "pruned": 0, "compared": 0}
    dual_search(ids, z, ids, z, 5, 8, counts=counts)
    every = len(leaves(cover_tree(z, 8))) ** 2
    assert counts["pruned"] > 0 and counts["compared"] < every / 2


def test_scores_beyond_doubles():
    ids = np.arange(4)
    q, d = np.array([[2.0**28, 1.0]]), np.array([[2.0**28, i] for i in (1.0, 2.0, 3.0, 4.0)])
    _, rows, scores = dual_search(np.array([9]), q, ids, d, 2)
    assert rows.tolist() == [3, 2] and scores.tolist() == [2**56 + 4, 2**56 + 3]
    with pytest.raises(ValueError, match="64 bits"):
        dual_search(np.array([9]), q * 2.0**10, ids, d * 2.0**10, 2)


@pytest.mark.parametrize("rows", [64, 150])
def test_several_blocks_give_the_same(spark, clustered, monkeypatch, rows):
    monkeypatch.setattr("shoal.llm.covertree.DATA_ROWS", rows)
    test_exact(spark, clustered)


def test_repeated_queries_and_mixed_lengths(spark):
    """Of rows that repeat a query's vec_id the smallest vector is the query; vectors meet those of their own length."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (20, [1.0, 1.0, 1.0]), (3, [0.0, 0.0, 2.0])]
    for search in (exact_top_k, approximate_top_k):
        got = {(r["query_id"], r["rank"], r["vec_id"]) for r in search(table(spark, [(i, v, 0, "x", 1) for i, v in rows])).collect()}
        assert got == {(0, 1, 1), (0, 2, 2), (20, 1, 3)}


def test_approximate_recall(spark, clustered):
    ids, x = clustered
    got = {}
    for r in approximate_top_k(table(spark, [(int(i), v.tolist(), 0, "x", 1) for i, v in zip(ids, x)])).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q, ranks in got.items():
        assert sorted(ranks) == [*range(1, 21)]
        assert all(s == pytest.approx(float(x[v] @ x[q]), abs=1e-9) for v, s in ranks.values())
        kth = brute(x, ids, q, 20)[-1][1]
        hits += sum(s >= kth - 1e-9 for _, s in ranks.values())
    assert len(got) == 45 and hits / (45 * 20) >= 0.9


def test_parts_are_balanced(clustered):
    _, x = clustered
    part = balanced_parts(x, neighbours(x, 10), 8)
    assert np.bincount(part, minlength=8).max() <= math.ceil(900 / 8 * 1.05) and (part >= 0).all()


@pytest.mark.parametrize("search, zero", [(exact_top_k, True), (approximate_top_k, False)])
def test_awkward_rows(spark, search, zero):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [float("inf"), 0.0]), (4, []), (5, [0.5, 0.5])]
    got = {}
    for r in search(table(spark, [(i, v, 0, "x", 1) for i, v in rows])).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got[0])[:4] == [(1, 1), (2, 2), (3, 2), (4, 5)]
    assert sorted(got) == ([0, 80] if zero else [0])
    assert search(table(spark, [])).count() == 0
