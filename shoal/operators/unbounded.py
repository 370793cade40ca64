"""Supersteps over a distributed graph where nothing bounds a search: ef is no less than the table.

No open row is ever left unexpanded then, and the order of expansions can't change what is found. So a step needn't choose: rows lie in blocks, and
in each step every block expands all open rows that it has, those met on the way too, until none is left in it, measures each row met, and
sends the edges that leave it to the blocks of their ends. Steps grow with the blocks that a path crosses, not with the rows. What queries have met is kept as one bit of a
query and row, and queries that come by the same row in the same step expand it together.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.distance import KERNELS
from shoal.operators.exact import _blocks, _measured, _slack, top_k
from shoal.operators.lineage import cut, release

BLOCK_ROWS, QUERY_ROWS = 16_384, 2_048
WORD = 64
#: What a block of rows gets for a block of queries: the queries; seeds of a query (``ids``); its state (``bits``: a row of words of each of its ids in order;
#: ``near_*``: the k nearest of each query); rows met by other blocks (``ids``, and ``bits`` of each).
QUERY, SEEDS, STATE, MET = range(4)
ITEMS = "qb int, block int, kind int, query_id long, ids array<long>, bits binary, near_q array<long>, near_v array<long>, near_d array<double>"
ARROW = pa.schema(
    [(name, pa.int32()) for name in ("qb", "block", "kind")]
    + [("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("bits", pa.binary())]
    + [("near_q", pa.list_(pa.int64())), ("near_v", pa.list_(pa.int64())), ("near_d", pa.list_(pa.float64()))]
)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists (null: 0), and all their values."""
    lists = column.combine_chunks()
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length; those that are null or hold null, NaN or infinite components have no distance."""
    n, flat = _lists(column)
    start, out = np.cumsum(n) - n, {}
    for size in np.unique(n[n > 0]).tolist():
        at = np.flatnonzero(n == size)
        x = flat[start[at][:, None] + np.arange(size)].astype(float)
        fine = np.isfinite(x).all(1)
        if fine.any():
            out[size] = at[fine], x[fine]
    return out


class _Edges:
    """Edges by their source's place."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        order = np.argsort(src, kind="stable")
        self.dst, self.first = dst[order], np.searchsorted(src[order], np.arange(n + 1))

    def ends(self, rows: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the edges of ``rows``, each once, and the union of the bits that come to it."""
        n = self.first[rows + 1] - self.first[rows]
        if not n.sum():
            return np.zeros(0, np.int64), bits[:0]
        dst = self.dst[np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(dst, kind="stable")
        dst = dst[order]
        first = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
        return dst[first], np.bitwise_or.reduceat(bits[np.repeat(np.arange(len(rows)), n)[order]], first, axis=0)


class _Nearest:
    """The k nearest rows of each query, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.ids, self.dist = k, np.zeros((queries, k), np.int64), np.full((queries, k), np.inf)

    def add(self, query: int, ids: np.ndarray, dist: np.ndarray) -> None:
        ids, dist = np.append(self.ids[query], ids), np.append(self.dist[query], dist)
        order = np.lexsort((ids, dist))[: self.k]
        self.ids[query], self.dist[query] = ids[order], dist[order]

    def measure(self, queries: dict, rows: dict, ids: np.ndarray, place: np.ndarray, met: np.ndarray) -> None:
        """Adds the rows newly met, by the bits of ``met`` at their ``place``."""
        for size in queries.keys() & rows.keys():
            (q_at, a), (r_at, c) = queries[size], rows[size]
            some = met[place[r_at]].any(1)
            r_at, c = r_at[some], c[some]
            if not len(c):
                continue
            slack = _slack("l2", a, c)
            for start in range(0, len(a), WORD):
                for i, d in enumerate(KERNELS["l2"](a[start : start + WORD], c), start):
                    word, bit = divmod(int(q_at[i]), WORD)
                    new = np.flatnonzero(met[place[r_at], word] >> np.uint64(bit) & np.uint64(1))
                    edge = np.partition(d[new], self.k - 1)[self.k - 1] if len(new) > self.k else np.inf
                    new = new[d[new] <= min(edge, self.dist[q_at[i], -1]) + 2 * slack[i]]
                    if len(new):
                        self.add(q_at[i], ids[r_at[new]], _measured("l2", a[i], c[new]))


def _advance(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of rows (vec_id, embedding, to, dst: blocks and ids of the ends of its edges) and what it gets: its new state, and the rows met of other blocks."""

    def advance(block: pa.Table, items: pa.Table) -> pa.Table:
        if not block.num_rows or not items.num_rows:
            return ARROW.empty_table()
        qb, here, kinds = items["qb"][0].as_py(), items["block"][0].as_py(), items["kind"].to_numpy()
        of = lambda kind: items.filter(pa.array(kinds == kind))
        asked = of(QUERY).sort_by("query_id")
        query_ids, row_ids = asked["query_id"].to_numpy(), block["vec_id"].to_numpy()
        ids, place = np.unique(row_ids, return_inverse=True)
        words = _blocks(len(query_ids), WORD)
        met, add, nearest = np.zeros((len(ids), words), np.uint64), np.zeros((len(ids), words), np.uint64), _Nearest(len(query_ids), k)
        for row in of(STATE).select(["bits", "near_q", "near_v", "near_d"]).to_batches():
            for bits, *near in zip(*(row[c] for c in range(4))):
                met |= np.frombuffer(bits.as_buffer(), np.uint64).reshape(met.shape)
                q, v, d = (x.values.to_numpy(zero_copy_only=False) for x in near)
                for at in np.split(np.arange(len(q)), np.flatnonzero(q[1:] != q[:-1]) + 1):
                    if len(at):
                        nearest.add(np.searchsorted(query_ids, q[at[0]]), v[at], d[at])
        seeds = of(SEEDS)
        for query_id, rows in zip(seeds["query_id"].to_numpy(), seeds["ids"]):
            word, bit = divmod(int(np.searchsorted(query_ids, query_id)), WORD)
            add[np.searchsorted(ids, rows.values.to_numpy(zero_copy_only=False)), word] |= np.uint64(1 << bit)
        sent = of(MET)
        for rows, bits in zip(sent["ids"], sent["bits"]):
            add[np.searchsorted(ids, rows.values.to_numpy(zero_copy_only=False))] |= np.frombuffer(bits.as_buffer(), np.uint64).reshape(-1, words)

        degree, to = _lists(block["to"])
        src, dst = np.repeat(place, degree), _lists(block["dst"])[1]
        inside = to == here
        edges, before = _Edges(src[inside], np.searchsorted(ids, dst[inside]), len(ids)), met.copy()
        rows, bits = np.arange(len(ids)), add & ~met
        while len(rows):
            some = bits.any(1)
            rows, bits = rows[some], bits[some]
            met[rows] |= bits
            rows, bits = edges.ends(rows, bits)
            bits = bits & ~met[rows]
        met_now = met & ~before
        nearest.measure(_by_length(asked["embedding"]), _by_length(block["embedding"]), row_ids, place, met_now)

        opened = np.flatnonzero(met_now.any(1))
        out = []
        for other in np.unique(to[~inside]).tolist():
            ends, bits = _Edges(src[to == other], dst[to == other], len(ids)).ends(opened, met_now[opened])
            if len(ends):
                out.append({"qb": qb, "block": other, "kind": MET, "ids": ends, "bits": bits.tobytes()})
        held = np.isfinite(nearest.dist)
        near = {"near_q": np.repeat(query_ids, held.sum(1)), "near_v": nearest.ids[held], "near_d": nearest.dist[held]}
        return pa.Table.from_pylist([{"qb": qb, "block": here, "kind": STATE, "bits": met.tobytes(), **near}, *out], ARROW)

    return advance


def _placed(vectors: DataFrame, owned: DataFrame | None) -> DataFrame:
    """vec_id, embedding, block: ranges of ids of about BLOCK_ROWS rows, within an owner's rows where there are owners."""
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull())
    rows = rows.withColumn("owner", F.lit(0).cast("long")) if owned is None else rows.join(owned.select("vec_id", F.coalesce(F.col("owner").cast("long"), F.lit(-1)).alias("owner")), "vec_id")
    sizes = {r["owner"]: r["n"] for r in rows.groupBy("owner").agg(F.count("*").alias("n")).collect()}
    each = _blocks(max(sizes.values(), default=0), BLOCK_ROWS)
    edges = {}
    if each > 1:
        edges = {r["owner"]: r["edges"] for r in rows.groupBy("owner").agg(F.percentile_approx("vec_id", [i / each for i in range(1, each)], 10_000).alias("edges")).collect()}
    ranges = rows.sparkSession.createDataFrame([(o, i * each, edges.get(o, [])) for i, o in enumerate(sorted(sizes))], "owner long, first int, edges array<long>")
    return rows.join(F.broadcast(ranges), "owner").select("vec_id", "embedding", (F.col("first") + F.size(F.filter("edges", lambda e: e < F.col("vec_id")))).alias("block"))


def supersteps(queries: DataFrame, seeds: DataFrame, edges: DataFrame, vectors: DataFrame, k: int, most: int | None = None, owned: DataFrame | None = None, leader: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id, dist: the k nearest of all rows that can be reached from a query's seeds (query_id, vec_id).

    A row's work is done in a block of its owner's rows (``owned``: vec_id, owner), and queries of one ``leader`` (query_id, leader) are searched together. A task has BLOCK_ROWS rows
    and their edges and QUERY_ROWS queries, about. Rows without a distance are passed through but aren't found. With ``most``, more steps are an error.
    """
    asked = queries.select("query_id", "embedding").where(F.col("query_id").isNotNull())
    asked = asked.withColumn("leader", F.lit(0).cast("long")) if leader is None else asked.join(leader.select("query_id", F.col("leader").cast("long").alias("leader")), "query_id")
    sizes = {r["leader"]: r["n"] for r in asked.groupBy("leader").agg(F.count("*").alias("n")).collect()}
    each, spark = _blocks(max(sizes.values(), default=0), QUERY_ROWS), queries.sparkSession
    numbers = spark.createDataFrame([(o, i * each) for i, o in enumerate(sorted(sizes))], "leader long, first int")
    asked = cut(asked.join(F.broadcast(numbers), "leader").select("query_id", "embedding", (F.col("first") + F.pmod(F.xxhash64("query_id"), F.lit(each)).cast("int")).alias("qb")))

    placed = cut(_placed(vectors, owned))
    block_of = placed.select("vec_id", "block").distinct()
    ends = edges.select("src", "dst").join(block_of.select(F.col("vec_id").alias("dst"), F.col("block").alias("to")), "dst")
    ends = ends.groupBy(F.col("src").alias("vec_id")).agg(F.collect_list(F.struct("to", "dst")).alias("e"))
    rows = cut(placed.join(ends, "vec_id", "left").select("block", "vec_id", "embedding", F.col("e.to").alias("to"), F.col("e.dst").alias("dst")))

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    blocks = rows.agg(F.max("block")).first()[0]
    rows = rows.withColumn("qb", every(len(sizes) * each))
    everywhere = asked.select("qb", every((blocks or 0) + 1).alias("block"), F.lit(QUERY).alias("kind"), "query_id", "embedding")
    first = seeds.select("query_id", "vec_id").join(block_of, "vec_id").join(asked.select("query_id", "qb"), "query_id")
    items = first.groupBy("qb", "block", "query_id").agg(F.collect_list("vec_id").alias("ids")).withColumn("kind", F.lit(SEEDS))
    last, advance, none = None, _advance(k), spark.createDataFrame([], ITEMS)
    for done in count(1):
        got = none.unionByName(everywhere, allowMissingColumns=True).unionByName(items, allowMissingColumns=True)
        items = cut(rows.groupBy("qb", "block").cogroup(got.groupBy("qb", "block")).applyInArrow(advance, ITEMS))
        if last is not None:
            release(last)
        last = items
        if items.where(F.col("kind") == MET).isEmpty():
            break
        if done == most:
            raise RuntimeError(f"rows are still open after {most} supersteps")
    found = items.where(F.col("kind") == STATE).select(F.explode(F.arrays_zip(F.col("near_q").alias("q"), F.col("near_v").alias("v"), F.col("near_d").alias("d"))).alias("f"))
    return top_k(found.select(F.col("f.q").alias("query_id"), F.col("f.v").alias("vec_id"), F.col("f.d").alias("dist")), k)
