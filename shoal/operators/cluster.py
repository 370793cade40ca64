"""Clustering: k-means on a bounded sample, assignment of all rows, balanced assignment, and cluster statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators.exact import nearest_centers
from shoal.operators.sample import of_size

SAMPLE_ROWS = 100_000
ROUNDS, GAIN = 15, 1e-5
BLOCK = 8_192


def sample_matrix(points: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 0) -> np.ndarray:
    """At most about ``rows`` vectors on the driver, in vec_id order."""
    got = of_size(points, rows, seed).orderBy("vec_id").limit(2 * rows).select("embedding").toPandas()
    return np.array(got["embedding"].tolist(), float)


def random_pivots(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k different rows."""
    return x[np.random.default_rng(seed).choice(len(x), k, replace=False)]


def plus_plus_pivots(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means++: each next pivot is drawn by squared distance to the nearest one so far."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        p = d / d.sum() if d.sum() > 0 else None
        chosen.append(int(rng.choice(len(x), p=p)))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def lloyd(x: np.ndarray, centers: np.ndarray, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[np.ndarray, float]:
    """Lloyd's iterations on a matrix; an empty cluster keeps its centre. Returns centres and the summed squared distance."""
    last = np.inf
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * x @ centers.T
        of = d.argmin(1)
        cost = float(np.maximum(d[np.arange(len(x)), of], 0).sum())
        sums, n = np.zeros_like(centers), np.bincount(of, minlength=len(centers))
        np.add.at(sums, of, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        if cost == 0 or (last - cost) / cost < gain:
            break
        last = cost
    return centers, cost


def centers_table(spark, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "part_id long, center array<double>")


def kmeans(points: DataFrame, k: int, seed: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """part_id, center: k-means++ and Lloyd on a sample of bounded size."""
    x = sample_matrix(points, sample_rows, seed)
    return centers_table(points.sparkSession, lloyd(x, plus_plus_pivots(x, min(k, len(x)), seed))[0])


def lloyd_step(points: DataFrame, centers: DataFrame) -> DataFrame:
    """One distributed iteration over all points: part_id, n, center (the mean; an empty cluster keeps its centre), moved (squared)."""
    near = nearest_centers(points, centers)
    member = near.join(points.select("vec_id", F.posexplode("embedding").alias("i", "x")), "vec_id")
    means = member.groupBy("part_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    means = means.groupBy("part_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return centers.join(means, "part_id", "left").select("part_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", "center").alias("center"))


def inverted_index(assigned: DataFrame) -> DataFrame:
    """part_id, ids: the rows of each centre. A list is a cell of the index; where cells can be unbounded use ``assigned`` as it is."""
    return assigned.groupBy("part_id").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """part_id, n, total_dist, max_dist."""
    return assigned.groupBy("part_id").agg(F.count("*").alias("n"), F.sum("dist").alias("total_dist"), F.max("dist").alias("max_dist"))


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("dist").alias("inertia"))


@dataclass
class Balancer:
    """Weight of a cluster's size against distance: decay * (max - mean distance of the largest cluster) / (rows of all) * (1 + deviation of the
    clusters' shares of all rows), clipped; nothing before any row is placed."""

    decay: float = 0.95
    low: float = 0.0
    high: float = 1.0

    def weight(self, n: np.ndarray, total: np.ndarray, largest: np.ndarray) -> float:
        if not n.sum():
            return 0.0
        c = int(n.argmax())
        return float(np.clip(self.decay * (largest[c] - total[c] / n[c]) / n.sum() * (1 + np.std(n / n.sum())), self.low, self.high))


def ratio_weight(sizes: np.ndarray, distances: np.ndarray, alpha: float = 0.5, decay: float = 0.95, low: float = 0.01, high: float = 1.0) -> float:
    """A weight from the ratio of the largest to the smallest cluster and the spread of the centres' mean distances (``distances``: row, centre)."""
    mean = distances.mean(0)
    spread = np.sqrt(((mean - mean.mean()) ** 2).sum())
    return float(np.clip(decay * (alpha * sizes.max() / (sizes.min() + 1e-6) + (1 - alpha) * spread), low, high))


def integer_kmeans(x: np.ndarray, k: int, rounds: int = 10, weight: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """k-means of integer vectors with centres cut to integers. With a ``weight``, rows are placed one after the other, at distance + weight * rows
    that the centre has. Centres, the centre of each row, and the summed squared distance."""
    centers, of = random_pivots(x, k, seed).astype(np.int64), np.zeros(len(x), np.int64)
    for _ in range(rounds):
        d = ((x[:, None, :].astype(np.int64) - centers[None]) ** 2).sum(2)
        if weight:
            n = np.zeros(k)
            for i, row in enumerate(d):
                of[i] = (row + weight * n).argmin()
                n[of[i]] += 1
        else:
            of = d.argmin(1)
        for c in range(k):
            if (of == c).any():
                centers[c] = x[of == c].mean(0).astype(np.int64)
    return centers, of, float(((x - centers[of]) ** 2).sum())


def partition_by_kmeans(points: DataFrame, parts: int, replicas: int = 1, balanced: bool = True, seed: int = 0, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Centres (part_id, center) fitted on a sample, and vec_id, replica_rank (0: owner), part_id, dist of every row: balanced, or the nearest."""
    fitted = kmeans(points, parts, seed, sample_rows)
    if balanced:
        c = np.array([r["center"] for r in fitted.orderBy("part_id").collect()])  # parts are few
        return fitted, balanced_assign(points, c, replicas)
    near = nearest_centers(points, fitted, replicas)
    return fitted, near.select("vec_id", (F.col("rank") - 1).alias("replica_rank"), "part_id", "dist")


def balanced_assign(points: DataFrame, centers: np.ndarray, replicas: int = 1, balancer: Balancer | None = None, additive: bool = False) -> DataFrame:
    """vec_id, replica_rank (0: owner), part_id, dist, where full clusters count as farther.

    Rows are dealt by a hash to tasks; a task takes its rows in blocks, in vec_id order, and after each block updates the clusters' sizes and the weight.
    Sizes are balanced in each task, so they are balanced in all, and no state is shared. Distance is weighed d * (1 + w * n)
    or, ``additive``, d + w * n; with weight 0 it is plain distance.
    """
    balancer, width = balancer or Balancer(), len(centers)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, largest = np.zeros((2, width)), np.zeros((2, width)), np.zeros((2, width))
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                b = batch.iloc[at : at + BLOCK]
                x = np.array(b["embedding"].tolist(), float)
                d = np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * x @ centers.T, 0)
                chosen = []
                for r in range(min(replicas, width)):
                    s = min(r, 1)
                    w = balancer.weight(n[s], total[s], largest[s])
                    cost = d + w * n[s] if additive else d * (1 + w * n[s])
                    for c in chosen:
                        cost[np.arange(len(x)), c] = np.inf
                    c = cost.argmin(1)
                    own = d[np.arange(len(x)), c]
                    n[s] += np.bincount(c, minlength=width)
                    total[s] += np.bincount(c, own, width)
                    np.maximum.at(largest[s], c, own)
                    chosen.append(c)
                    yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy(), "replica_rank": np.full(len(x), r, np.int32), "part_id": c.astype(np.int64), "dist": own})

    dealt = points.select("vec_id", "embedding").repartition("vec_id").sortWithinPartitions("vec_id")
    return dealt.mapInPandas(assign, "vec_id long, replica_rank int, part_id long, dist double")


def parts_for_budget(points: DataFrame, rows_budget: int, start: int = 3, most: int = 256, seed: int = 0) -> int:
    """The fewest clusters (in steps of two) whose largest is estimated, on the sample, to hold at most ``rows_budget`` rows."""
    n, x, k = points.count(), sample_matrix(points, seed=seed), start
    while k < min(most, len(x)):
        centers, _ = lloyd(x, plus_plus_pivots(x, k, seed))
        of = ((x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * x @ centers.T).argmin(1)
        if np.bincount(of).max() * n / max(1, len(x)) <= rows_budget:
            break
        k += 2
    return k
