"""Exact k-nearest-neighbour search and edits of the searched table.

A search is a join of queries with all rows, in blocks: rows go to blocks of bounded size by a hash, each block of queries
visits every block of rows, a task compares one pair of blocks as matrices and sends ids and distances of its k best, and a grouped window
merges the blocks' results. Ids are decided by (distance, vec_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.distance import KERNELS

BASE_ROWS, QUERY_ROWS = 16_384, 2_048
#: Distances of a matrix product are good to about 1e-12 of the vectors' norms; candidates within this share of them from the kth stay until
#: exact distances have decided.
TOLERANCE = 1e-9


def _blocks(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def top_k(found: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """query_id, rank (from 1), vec_id, dist: the k nearest of each query, ties to the smaller vec_id."""
    order = Window.partitionBy(by).orderBy("dist", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(by, "rank", "vec_id", "dist")


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """The k nearest of several shards' results."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out, k)


def whole(vectors: DataFrame) -> DataFrame:
    """The rows that can be compared: no vector is null, empty or has a null component."""
    v = F.col("embedding")
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(True)))


def _slack(metric: str, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How far the kernel's distances of each row of a may be off."""
    of_a, of_c = np.linalg.norm(a, axis=1), np.linalg.norm(c, axis=1).max()
    return TOLERANCE * (1 + {"l2": of_a**2 + of_c**2, "mips": of_a * of_c, "cosine": np.ones(len(a))}[metric])


def _fold(terms: np.ndarray) -> np.ndarray:
    """Sums of the rows from left to right, as the expressions of ``functions.distance`` and SQL add: another order differs in the last bits, which may decide a rank."""
    return np.add.accumulate(terms, axis=1)[:, -1]


def _measured(metric: str, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of one vector to each row of c, without the kernel's cancellation."""
    if metric == "l2":
        return _fold((c - a) ** 2)
    dots = _fold(c * a)
    return 1 - dots if metric == "mips" else 1 - dots / (np.sqrt(_fold((a * a)[None])) * np.sqrt(_fold(c * c)))


def _blockwise(queries: DataFrame, base: DataFrame, metric: str, choose, within: Column | None = None) -> DataFrame:
    """query_id, vec_id, dist: of each pair of blocks, the rows that ``choose`` takes for a query (its distances by the kernel, their slack, ids, exact distances by
    place). Vectors meet those of their own length (and of the same value of ``within``, an integer column of both tables), and stay in the task."""
    queries, base = whole(queries), whole(base)
    nb, nq = _blocks(base.count(), BASE_ROWS), _blocks(queries.count(), QUERY_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # cogroup compares keys as they are: an int and a long of the same value are dealt to different tasks
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    within = (F.lit(0) if within is None else within).cast("long")
    # new names on both sides, which may come of one table
    q = queries.select(within.alias("q_in"), F.col("query_id").alias("q_id"), F.col("embedding").alias("q_v"), F.size("embedding").alias("q_n"), dealt("query_id", nq).alias("q_qb")).withColumn("q_bb", every(nb))
    b = base.select(within.alias("b_in"), F.col("vec_id").alias("b_id"), F.col("embedding").alias("b_v"), F.size("embedding").alias("b_n"), dealt("vec_id", nb).alias("b_bb")).withColumn("b_qb", every(nq))
    kernel = KERNELS[metric]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, rows, dists = [], [], []
        if len(left) and len(right):
            a, c = np.array(left["q_v"].tolist(), float), np.array(right["b_v"].tolist(), float)
            qi, bi = left["q_id"].to_numpy(), right["b_id"].to_numpy()
            slack = _slack(metric, a, c)
            for i, d in enumerate(kernel(a, c)):
                found, dist = choose(qi[i], d, slack[i], bi, lambda at, i=i: _measured(metric, a[i], c[at]))
                ids.append(np.full(len(found), qi[i]))
                rows.append(bi[found])
                dists.append(dist)
        none = [np.zeros(0)]
        return pd.DataFrame({"query_id": np.concatenate(ids or none).astype(np.int64), "vec_id": np.concatenate(rows or none).astype(np.int64), "dist": np.concatenate(dists or none)})

    return q.groupBy("q_in", "q_n", "q_qb", "q_bb").cogroup(b.groupBy("b_in", "b_n", "b_qb", "b_bb")).applyInPandas(search, "query_id long, vec_id long, dist double")


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", keep_self: bool = True, allowed: Column | None = None, radius: float | None = None, within: Column | None = None) -> DataFrame:
    """The k nearest rows of ``base`` (vec_id, embedding) to each query (query_id, embedding).

    ``allowed`` filters base before the search. With ``radius`` only rows within it count. Without ``keep_self`` a row isn't a
    neighbour of the query of its own id. If k exceeds the rows, all are returned. Vectors that are null or incomplete take no part; a
    task sends k rows of a query at most, however many tie. ``within`` is an integer column of both tables: a query's rows (one for each of its values) meet
    the rows of ``base`` of the same value only.
    """

    def choose(query_id, d, slack, ids, measure):
        if not keep_self:
            d = np.where(ids == query_id, np.inf, d)
        edge = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        near = np.flatnonzero((d <= (edge if radius is None else min(edge, radius)) + 2 * slack) & np.isfinite(d))
        dist = measure(near)
        order = np.lexsort((ids[near], dist))[:k]
        order = order if radius is None else order[dist[order] <= radius]
        return near[order], dist[order]

    return top_k(_blockwise(queries, base if allowed is None else base.where(allowed), metric, choose, within), k)


def range_search(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2", keep_self: bool = False) -> DataFrame:
    """All rows within ``radius``, however many: query_id, vec_id, dist."""

    def choose(query_id, d, slack, ids, measure):
        near = np.flatnonzero((d <= radius + slack) & (keep_self | (ids != query_id)))
        dist = measure(near)
        return near[dist <= radius], dist[dist <= radius]

    return _blockwise(queries, base, metric, choose)


def upsert(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows of ``updates`` replace those of their vec_id, or are added."""
    return base.join(updates, "vec_id", "left_anti").unionByName(updates)


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the rows of the given vec_ids; unknown ids are ignored."""
    return base.join(ids, "vec_id", "left_anti")


def nearest_centers(points: DataFrame, centers: DataFrame, k: int = 1, metric: str = "l2") -> DataFrame:
    """vec_id, rank (from 1), part_id, dist: each point's k nearest centres (part_id, center), ties to the smaller part_id.

    Up to MAX_CENTERS centres are sent to all tasks; more are searched in blocks, as rows are by ``knn_join`` (vec_ids are unique then).
    """
    rows = centers.select("part_id", "center").orderBy("part_id").limit(MAX_CENTERS + 1).collect()
    if len(rows) > MAX_CENTERS:
        found = knn_join(points.select(F.col("vec_id").alias("query_id"), "embedding"), centers.select(F.col("part_id").alias("vec_id"), F.col("center").alias("embedding")), k, metric)
        return found.select(F.col("query_id").alias("vec_id"), "rank", F.col("vec_id").cast("long").alias("part_id"), "dist")
    ids, c = np.array([r["part_id"] for r in rows], np.int64), np.array([r["center"] for r in rows], float)
    kernel, n = KERNELS[metric], min(k, len(rows))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.array(b["embedding"].tolist(), float)
            best = np.argsort(kernel(x, c), axis=1, kind="stable")[:, :n]
            d = ((x[:, None, :] - c[best]) ** 2).sum(2) if metric == "l2" else np.take_along_axis(kernel(x, c), best, 1)
            yield pd.DataFrame({"vec_id": np.repeat(b["vec_id"].to_numpy(), n), "rank": np.tile(np.arange(1, n + 1, dtype=np.int32), len(b)), "part_id": ids[best].ravel(), "dist": d.ravel()})

    return points.select("vec_id", "embedding").mapInPandas(assign, "vec_id long, rank int, part_id long, dist double")


#: Centres that are sent to all tasks, at most.
MAX_CENTERS = 4096
