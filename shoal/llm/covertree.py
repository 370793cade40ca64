"""Exact top-k search by inner product with dual-tree traversal of cover trees.

A task has a block of queries and a block of data and indexes both: in a cover tree, the children of a node are a net of its
rows at a scale of half the node's (or, where that net would have more than a node's fan, at the scale which so many reach): every row is within
the scale of its child's centre, and no two centres are closer than it. Pairs of a query node and a data node are taken from both roots down, the
one of larger radius opened first, the best bound first: no product of a row of a with a row of b is more than
<a, b> + ra |b| + rb |a| + ra rb. A pair is pruned, with all pairs below it, when that is below the worst kth score of the query node's rows, which rises as
leaves are compared. Leaves hold the rows below which a tree would not pay; they are compared as matrices.

Where there are several blocks of data, the first gives every query a bound that all others start from.

Scores are integers: products of doubles where no sum can reach 2**53, else of 64-bit integers; sums that could reach 2**63 are an error.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do empty ones or rows without vec_id; vectors
are compared with those of their own length; rows that repeat a query's vec_id are its own rows, of which the smallest vector
is the query; other repeated rows are candidates each; scores that tie go by the smaller vec_id; fewer than k candidates give fewer ranks; columns other
than vec_id and embedding are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.blocks import DATA_ROWS, QUERY_ROWS, best, queries_of, searched, usable
from shoal.llm.common import stash

LEAF = 256


#: Children of a node, at most, for each leaf that its rows would fill.
FAN = 2
NONE = np.iinfo(np.int64).min


class Node:
    """A node of a cover tree: its rows, the row it is centred on, how far its rows are from that, its parent and children; of queries, also the worst kth score."""

    __slots__ = ("rows", "center", "norm", "radius", "children", "parent", "worst")

    def __init__(self, rows: np.ndarray, center: np.ndarray, radius: float, parent: Node | None = None):
        self.rows, self.center, self.radius, self.parent, self.children, self.worst = rows, center, radius, parent, [], NONE
        self.norm = float(np.linalg.norm(center))


def distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - center) ** 2).sum(1), 0))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node:
    """Built from the top: each node's net is drawn farthest point first. So all its points are at least as far from each other as the last drawn was from
    those before, which is at least as far as any row is from its centre: the net's scale."""
    root = Node(np.arange(len(points)), points[0], float(distances(points, points[0]).max(initial=0)))
    todo = [(root, root.radius)]
    while todo:
        node, scale = todo.pop()
        if len(node.rows) <= leaf or node.radius == 0:
            continue
        own = points[node.rows]
        near, of = distances(own, node.center), np.zeros(len(own), np.int64)
        centers = [node.center]
        while near.max() > scale / 2 and len(centers) < max(2, FAN * (len(own) // leaf)):
            centers.append(own[near.argmax()])
            d = distances(own, centers[-1])
            closer = d < near
            near[closer], of[closer] = d[closer], len(centers) - 1
        for c, center in enumerate(centers):
            mine = of == c
            if mine.any():
                child = Node(node.rows[mine], center, float(near[mine].max()), node)
                node.children.append(child)
                if mine.sum() < len(own):
                    todo.append((child, float(near.max())))
    return root


def leaves(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        todo += n.children
        if not n.children:
            out.append(n)
    return out


def bound(a: Node, b: Node) -> float:
    """No product of rows of the two is more."""
    reach = a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return float(a.center @ b.center) + reach + 1e-9 * (a.norm * b.norm + reach + 1)  # for rounding


def dual_search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, leaf: int = LEAF, floor: np.ndarray | None = None, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and data, and scores, of each query's k best rows but those of its own id; ties to smaller id.

    ``floor``: scores below which a query's rows are of no interest. ``counts`` gets how many pairs of nodes were opened, pruned and compared as leaves.
    """
    largest = float(np.abs(queries).max()) * float(np.abs(data).max()) * queries.shape[1]
    if largest >= 2**63:
        raise ValueError("scores may exceed 64 bits")
    left, right = (queries, data) if largest < 2**53 else (queries.astype(np.int64), data.astype(np.int64))
    worst = np.full(len(queries), NONE) if floor is None else floor.astype(np.int64)
    held_s, held_d = np.full((len(queries), k), NONE), np.full((len(queries), k), -1, np.int64)
    done = {"opened": 0, "pruned": 0, "compared": 0} if counts is None else counts
    place = np.append(np.argsort(np.argsort(ids, kind="stable"), kind="stable"), len(ids))  # of each row in the order of ids

    def compare(a: Node, b: Node) -> None:
        scores = (left[a.rows] @ right[b.rows].T).astype(np.int64)
        scores[query_ids[a.rows][:, None] == ids[b.rows][None, :]] = NONE
        open_ = np.flatnonzero(((scores >= worst[a.rows][:, None]) & (scores != NONE)).any(1))
        if not len(open_):
            return
        rows = a.rows[open_]
        s = np.concatenate([held_s[rows], scores[open_]], axis=1)
        d = np.concatenate([held_d[rows], np.broadcast_to(b.rows, (len(rows), len(b.rows)))], axis=1)
        if s.shape[1] > k:
            # everything that ties with the kth stays until ids have decided
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
            width = max(k, int((s >= kth).sum(1).max()))
            keep = np.argpartition(s, s.shape[1] - width, axis=1)[:, s.shape[1] - width :]
            s, d = np.take_along_axis(s, keep, 1), np.take_along_axis(d, keep, 1)
        order = np.lexsort((place[d], ~s), axis=1)[:, :k]  # ~s falls as s rises, without overflow
        held_s[rows], held_d[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
        worst[rows] = np.maximum(worst[rows], held_s[rows, -1])
        node: Node | None = a
        node.worst = int(worst[a.rows].min())
        while node := node.parent:
            node.worst = min(c.worst for c in node.children)

    top = cover_tree(queries.astype(np.float64), leaf)
    if floor is not None:
        todo = [top]
        while todo:
            node = todo.pop()
            node.worst = int(worst[node.rows].min())
            todo += node.children
    pairs = [(top, cover_tree(data.astype(np.float64), leaf))]
    while pairs:
        a, b = pairs.pop()
        if bound(a, b) < a.worst:
            done["pruned"] += 1
        elif not a.children and not b.children:
            done["compared"] += 1
            compare(a, b)
        else:
            done["opened"] += 1
            if b.children and (not a.children or b.radius * a.norm >= a.radius * b.norm):
                below = [(a, c) for c in b.children]
            else:
                below = [(c, b) for c in a.children]
            pairs += sorted(below, key=lambda p: bound(*p))  # the best is taken first
    q, r = np.nonzero((held_s != NONE) & (held_s >= (worst[:, None] if floor is None else floor.astype(np.int64)[:, None])))
    return q, held_d[q, r], held_s[q, r]


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each query (vec_id divisible by ``every``), on
    components floor(scale * x). Every pair of a query block and a data block is a task; blocks have bounded size."""
    rows = usable(vectors)
    rows = stash(rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")), "vectors").withColumn("dim", F.size("v"))
    n = rows.count()
    data_blocks, query_blocks = max(1, -(-n // DATA_ROWS)), max(1, -(-n // (every * QUERY_ROWS)))
    at = lambda blocks: F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    numbers = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi)))
    queries = queries_of(rows, every).withColumn("dim", F.size("v")).withColumn("qb", at(query_blocks))
    data = rows.withColumn("db", at(data_blocks)).withColumn("qb", numbers(0, query_blocks - 1))
    pair = F.array("dim", "qb", "db")

    def search(queries: DataFrame, data: DataFrame) -> DataFrame:
        def one(query_ids, q, ids, d, floor=None):
            return dual_search(query_ids, q, ids, d, k, floor=floor)

        given = [c for c in queries.columns if c == "floor"]
        return searched(queries.select(pair.alias("pair"), "vec_id", "v", *given), data.select(pair.alias("pair"), "vec_id", "v"), one, "long", k)

    found = search(queries.withColumn("db", F.lit(0)), data.where("db = 0"))
    if data_blocks > 1:
        found = stash(found, "first-block")
        floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        bounded = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE))).withColumn("db", numbers(1, data_blocks - 1))
        found = best(found.drop("rank").unionByName(search(bounded, data.where("db > 0")).drop("rank")), k)
    return found.withColumn("rank", F.col("rank").cast("int"))
