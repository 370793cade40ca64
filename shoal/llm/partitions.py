"""Approximate nearest neighbours by learned partitions.

On a sample of at most SAMPLE rows: a neighbour graph, a balanced partitioning of it (every part has its share of the rows, give or
take SLACK; rows move to the part most of their neighbours are in), and a small classifier that learns the parts. The classifier
puts every row of the table in its most probable part and routes a query to its several most probable parts, whose rows are
reranked by the exact inner product.

There is a part for each PART_ROWS rows of the table, PARTS at least and as many as the sample has rows for (SAMPLE / LEAST_ROWS) at most. How many parts are
probed is set on the sample: the fewest at which sample rows that took no part in the fit find TARGET of their true neighbours, with half as many
misses again as a margin; data without structure makes that most parts, structured data few.

Defined cases: vectors that are null, zero, empty or hold a null or non-finite component take no part, nor do rows without vec_id; vectors of another
length than most are a part for each length, which queries of that length probe; rows that repeat a query's vec_id are its own rows, of which the
smallest vector is the query; fewer than k candidates in the probed parts are completed by probing all parts; scores that tie go by the smaller vec_id;
columns other than vec_id and embedding are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.blocks import DATA_ROWS, QUERY_ROWS, matrix, queries_of, searched, usable
from shoal.llm.common import stash

SAMPLE, PARTS, PART_ROWS, LEAST_ROWS, NEIGHBOURS, SLACK, TARGET = 8192, 16, 8192, 64, 12, 0.05, 0.95
ROUNDS, STEPS = 30, 200


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each row's k largest inner products, itself left out; in small blocks of rows, in single precision."""
    out, x, k = [], x.astype(np.float32), min(k, len(x) - 1)
    for at in range(0, len(x), 256):
        s = x[at : at + 256] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out.append(np.argpartition(s, len(x) - k, axis=1)[:, len(x) - k :].astype(np.int32) if k > 0 else np.zeros((len(s), 0), np.int32))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Parts of at most (1 + SLACK) of an even share. Rows start at the nearest of random pivots with room, then move, most gain first, to
    the part that has most of their neighbours while it has room."""
    n = len(x)
    room = int(np.ceil(n / parts * (1 + SLACK)))
    pivots = x[np.random.default_rng(seed).choice(n, parts, replace=False)]
    liking = x @ pivots.T

    def place(liking: np.ndarray, now: np.ndarray | None) -> np.ndarray:
        part, sizes = np.full(n, -1) if now is None else now.copy(), np.zeros(parts, int) if now is None else np.bincount(now, minlength=parts)
        best = np.sort(liking, axis=1)
        order = np.argsort(-(best[:, -1] - best[:, 0] if now is None else liking.max(1) - liking[np.arange(n), now]), kind="stable")
        for i in order:
            for p in np.argsort(-liking[i], kind="stable"):
                if p == part[i]:
                    break
                if sizes[p] < room:
                    if part[i] >= 0:
                        sizes[part[i]] -= 1
                    part[i], sizes[p] = p, sizes[p] + 1
                    break
        return part

    part = place(liking, None)
    for _ in range(ROUNDS):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        moved = place(votes, part)
        if (moved == part).all():
            break
        part = moved
    return part


def fit_router(x: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """Softmax regression of the part on the direction (with a constant); weights (dim + 1) x parts."""
    a = np.column_stack([unit(x), np.ones(len(x))])
    y = np.eye(parts)[part]
    w, m, v = np.zeros((a.shape[1], parts)), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = a @ w
        p = np.exp(z - z.max(1, keepdims=True))
        g = a.T @ (p / p.sum(1, keepdims=True) - y) / len(a) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def ranked_parts(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Parts of each row, most probable first."""
    return np.argsort(-(np.column_stack([unit(x), np.ones(len(x))]) @ w), axis=1, kind="stable")


def probes_needed(x: np.ndarray, test: np.ndarray, w: np.ndarray, k: int, target: float = TARGET) -> int:
    """The fewest probed parts at which the rows ``test`` of the sample find enough of their k true neighbours in it, the margin included."""
    graph, ranked = neighbours(x, k)[test], ranked_parts(x, w)
    place = np.argsort(ranked[test], axis=1)  # of each part in each row's ranking
    needed = np.take_along_axis(place, ranked[:, 0][graph], 1)
    return int(np.quantile(needed, 1 - (1 - target) / 1.5, method="higher")) + 1 if needed.size else ranked.shape[1]


class Router:
    """Weights of the classifier and how many parts to probe."""

    def __init__(self, weights: np.ndarray, probes: int):
        self.weights, self.probes = weights, probes

    @classmethod
    def fit(cls, x: np.ndarray, k: int, parts: int = PARTS) -> Router:
        test = np.arange(len(x)) % 8 == 0 if len(x) > 8 else np.zeros(len(x), bool)
        train = x[~test]
        parts = min(parts, len(train))
        w = fit_router(train, balanced_parts(train, neighbours(train, NEIGHBOURS), parts), parts)
        return cls(w, min(parts, probes_needed(x, test, w, k)))


def approximate_top_k(vectors: DataFrame, k: int = 20, every: int = 20, parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each query (vec_id divisible by ``every``) the k rows found with the largest inner product."""
    rows = stash(usable(vectors, nonzero=True), "vectors")
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim, n = dims["dim"], dims["count"]
    h = F.xxhash64("vec_id", "v")
    sample = rows.where(F.size("v") == dim).select("v", "vec_id", h.alias("h")).where(F.pmod("h", F.lit(1 << 20)) < min(1 << 20, int(1.2 * SAMPLE / n * (1 << 20)) + 1)).orderBy("h", "vec_id").limit(SAMPLE).toPandas()
    router = Router.fit(matrix(sample["v"]), k, parts or max(PARTS, min(SAMPLE // LEAST_ROWS, n // PART_ROWS)))
    weights, probes = router.weights, router.probes

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sizes = b["v"].map(len)
                usual = (sizes == dim).to_numpy()
                ranked = np.empty(len(b), object)
                if usual.any():
                    for i, of in zip(np.flatnonzero(usual), ranked_parts(matrix(b["v"][usual]), weights).astype(np.int32)):
                        ranked[i] = of
                for i in np.flatnonzero(~usual):
                    ranked[i] = np.array([-sizes.iloc[i]], np.int32)
                yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "parts": ranked})

    routed = stash(rows.mapInPandas(route, "vec_id long, v array<double>, parts array<int>"), "routed")
    data = routed.select("vec_id", "v", F.col("parts")[0].alias("part"))
    sizes = {**dict.fromkeys(range(weights.shape[1]), 0), **{r["part"]: r["count"] for r in data.groupBy("part").count().collect()}}
    queries = routed.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("v", "parts")).alias("q")).select("vec_id", "q.v", "q.parts")

    blocks_of = {p: max(1, -(-size // DATA_ROWS)) for p, size in sizes.items()}
    count = F.element_at(F.create_map(*[F.lit(x) for kv in blocks_of.items() for x in kv]), F.col("part"))
    query_blocks = max(1, -(-n * probes // (every * weights.shape[1] * QUERY_ROWS)))
    at = lambda blocks: F.pmod(F.xxhash64("vec_id", "v"), blocks).cast("int")
    data = data.withColumn("db", at(count)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    # the fewest parts, from the most probable on, that hold k other rows (and the query) and are ``probes`` at least
    held = F.transform("parts", lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), p))
    short = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.aggregate(F.slice(held, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)), lambda s: s <= k))
    queries = queries.withColumn("part", F.explode(F.slice("parts", F.lit(1), F.greatest(F.lit(probes), short + 1)))).withColumn("qb", at(F.lit(query_blocks)))
    queries = queries.withColumn("db", F.explode(F.sequence(F.lit(0), count - 1)))
    pair = F.array("part", "qb", "db")

    def search(query_ids, q, ids, d):
        scores = q @ d.T
        scores[query_ids[:, None] == ids[None, :]] = -np.inf
        if scores.shape[1] > k:
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            qi, di = np.nonzero((scores >= kth - 1e-9) & np.isfinite(scores))
        else:
            qi, di = np.nonzero(np.isfinite(scores))
        scores = np.einsum("ij,ij->i", q[qi], d[di])
        order = np.lexsort((ids[di], -scores, qi))  # equal vectors may be many: k of each query go on
        qi, di, scores = qi[order], di[order], scores[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        return qi[keep], di[keep], scores[keep]

    return searched(queries.select(pair.alias("pair"), "vec_id", "v"), data.select(pair.alias("pair"), "vec_id", "v"), search, "double", k).withColumn("rank", F.col("rank").cast("int"))
