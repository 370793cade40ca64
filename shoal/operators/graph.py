"""Proximity graphs: exact neighbour graphs, pruned graphs of each partition, merging, layout by partition, and statistics.

A graph is rows (vec_id, neighbors array<long>), or edges (src, dst[, dist]).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.distance import l2_sq
from shoal.operators.exact import knn_join
from shoal.operators.lineage import cut

INLINE = 2


def knn_graph(vectors: DataFrame, degree: int) -> DataFrame:
    """src, rank, dst, dist: the nearest other rows of every row."""
    found = knn_join(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), vectors, degree, keep_self=False)
    return found.select(F.col("query_id").alias("src"), "rank", F.col("vec_id").alias("dst"), "dist")


def adjacency(edges: DataFrame) -> DataFrame:
    """vec_id, neighbors in the order of (dist, dst)."""
    return edges.groupBy(F.col("src").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dist", "dst"))), lambda s: s["dst"]).alias("neighbors"))


def edges_of(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("vec_id").alias("src"), F.explode("neighbors").alias("dst"))


def robust_prune(point: int, candidates: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of the candidates, nearest first, those that no kept one is alpha times nearer to than the point is."""
    candidates = np.unique(candidates[candidates != point])
    d = ((x[candidates] - x[point]) ** 2).sum(1)
    order = np.lexsort((candidates, d))
    candidates, d, kept = candidates[order], d[order], []
    while len(candidates) and len(kept) < degree:
        kept.append(candidates[0])
        between = ((x[candidates] - x[candidates[0]]) ** 2).sum(1)
        stay = alpha * between > d
        stay[0] = False
        candidates, d = candidates[stay], d[stay]
    return np.array(kept, np.int64)


def best_first(graph: list[np.ndarray], x: np.ndarray, q: np.ndarray, entry: int, ef: int) -> tuple[list[tuple[float, int]], list[int]]:
    """Best-first search of a graph in memory: the ef best (distance, row), and the rows expanded in order."""
    import heapq

    first = float(((x[entry] - q) ** 2).sum())
    todo, top, seen, path = [(first, entry)], [(-first, -entry)], {entry}, []
    while todo:
        d, v = heapq.heappop(todo)
        if len(top) >= ef and d > -top[0][0]:
            break
        path.append(v)
        new = [u for u in graph[v] if u not in seen]
        if not new:
            continue
        seen.update(new)
        for du, u in zip(((x[new] - q) ** 2).sum(1).tolist(), new):
            if len(top) < ef or du < -top[0][0]:
                heapq.heappush(todo, (du, int(u)))
                heapq.heappush(top, (-du, -int(u)))
                if len(top) > ef:
                    heapq.heappop(top)
    return sorted((-d, -v) for d, v in top), path


def pruned_graph(x: np.ndarray, degree: int, build: int, alpha: float = 1.2, seed: int = 0) -> tuple[list[np.ndarray], int]:
    """A navigable graph by greedy search and robust pruning, in two passes (alpha 1, then ``alpha``); and its medoid."""
    n = len(x)
    medoid = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    rng = np.random.default_rng(seed)
    graph = [np.setdiff1d(rng.choice(n, min(n, degree + 1), replace=False), [i])[:degree] for i in range(n)]
    for a in (1.0, alpha):
        for i in rng.permutation(n):
            top, path = best_first(graph, x, x[i], medoid, build)
            graph[i] = robust_prune(i, np.concatenate([path, [v for _, v in top], graph[i]]).astype(np.int64), x, degree, a)
            for j in graph[i]:
                if i not in graph[j]:
                    more = np.append(graph[j], i)
                    graph[j] = more if len(more) <= degree else robust_prune(int(j), more, x, degree, a)
    return graph, medoid


def build_part_graphs(parts: DataFrame, degree: int = 16, build: int = 40, alpha: float = 1.2) -> DataFrame:
    """part_id, vec_id, neighbors (vec_ids), entry: a pruned graph of each part (part_id, vec_id, embedding).

    A part is built in one task, as it is meant to fit one machine: size parts by ``cluster.parts_for_budget``.
    """

    def build_one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        ids = part["vec_id"].to_numpy()
        graph, medoid = pruned_graph(np.array(part["embedding"].tolist(), float), degree, build, alpha)
        return pd.DataFrame({"part_id": part["part_id"].to_numpy(), "vec_id": ids, "neighbors": [ids[g] for g in graph], "entry": np.full(len(ids), ids[medoid])})

    return parts.select("part_id", "vec_id", "embedding").groupBy("part_id").applyInPandas(build_one, "part_id long, vec_id long, neighbors array<long>, entry long")


def merge_graphs(edges: DataFrame, vectors: DataFrame, degree: int) -> DataFrame:
    """src, rank, dst, dist: the union of shards' edges (src, dst), each once, cut to the nearest ``degree`` of a node."""
    once = edges.select("src", "dst").distinct()
    a, b = vectors.select(F.col("vec_id").alias("src"), F.col("embedding").alias("a")), vectors.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("b"))
    near = once.join(a, "src").join(b, "dst").select("src", "dst", l2_sq(F.col("a"), F.col("b")).alias("dist"))
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= degree).select("src", "rank", "dst", "dist")


def to_positions(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges with ids rewritten to positions: src_pos, src_part, dst_pos, dst_part."""
    s = positions.select(F.col("vec_id").alias("src"), F.col("pos").alias("src_pos"), F.col("part_id").alias("src_part"))
    d = positions.select(F.col("vec_id").alias("dst"), F.col("pos").alias("dst_pos"), F.col("part_id").alias("dst_part"))
    return edges.select("src", "dst").join(s, "src").join(d, "dst").select("src_pos", "src_part", "dst_pos", "dst_part")


def layout(placed: DataFrame) -> DataFrame:
    """src_pos, src_part, dst_part, ids (ascending), n, kind: each node's neighbours grouped by the part that owns them: ``local``, ``inline`` (few, kept
    with the node) or ``shipped`` (kept with their owner)."""
    groups = placed.groupBy("src_pos", "src_part", "dst_part").agg(F.array_sort(F.collect_list("dst_pos")).alias("ids"))
    kind = F.when(F.col("src_part") == F.col("dst_part"), "local").when(F.size("ids") <= INLINE, "inline").otherwise("shipped")
    return groups.select("src_pos", "src_part", "dst_part", "ids", F.size("ids").cast("long").alias("n"), kind.alias("kind"))


def layout_differences(groups: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges that a layout lost or made up; empty if it is right."""
    back = groups.select("src_pos", F.explode("ids").alias("dst_pos"))
    edges = placed.select("src_pos", "dst_pos")
    return back.exceptAll(edges).unionByName(edges.exceptAll(back))


def local_edges(placed: DataFrame) -> DataFrame:
    """Edges that stay within a part, as each part's own graph."""
    return placed.where("src_part = dst_part").select("src_part", "src_pos", "dst_pos")


def degree_histogram(edges: DataFrame) -> DataFrame:
    """degree, n of incoming edges."""
    return edges.groupBy("dst").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


def part_skew(placed: DataFrame) -> DataFrame:
    """decile, n: nodes by the share of their neighbours that the commonest part has."""
    by_part = placed.groupBy("src_pos", "dst_part").agg(F.count("*").alias("n"))
    share = by_part.groupBy("src_pos").agg((F.max("n") / F.sum("n")).alias("share"))
    return share.groupBy(F.floor(F.col("share") * 10).alias("decile")).agg(F.count("*").alias("n"))


def hops(edges: DataFrame, entry: DataFrame, most: int = 5) -> DataFrame:
    """hop, vec_id: nodes by their distance in edges from the entry nodes (vec_id), breadth first; lineage is cut at each hop."""
    edges = cut(edges)
    seen = entry.select(F.lit(0).alias("hop"), "vec_id")
    frontier = seen
    for h in range(1, most + 1):
        reached = frontier.join(edges, frontier["vec_id"] == edges["src"]).select(F.col("dst").alias("vec_id")).distinct()
        frontier = cut(reached.join(seen.select("vec_id"), "vec_id", "left_anti").select(F.lit(h).alias("hop"), "vec_id"))
        seen = seen.unionByName(frontier)
    return seen


def medoids(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """part_id, entry: the row nearest to its part's mean."""
    rows = assigned.select("vec_id", "part_id").join(vectors.select("vec_id", "embedding"), "vec_id")
    means = rows.select("part_id", F.posexplode("embedding").alias("i", "x")).groupBy("part_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy("part_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    d = rows.join(means, "part_id").select("part_id", "vec_id", l2_sq(F.col("embedding"), F.col("mean")).alias("dist"))
    return d.groupBy("part_id").agg(F.min(F.struct("dist", "vec_id"))["vec_id"].alias("entry"))


def by_degree(edges: DataFrame) -> DataFrame:
    """vec_id, degree, place: nodes reordered by falling in-degree, places from 0. Ranks within a degree on offsets of the (few) degrees."""
    n = edges.groupBy(F.col("dst").alias("vec_id")).agg(F.count("*").alias("degree"))
    counts = n.groupBy("degree").agg(F.count("*").alias("c"))
    offset = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("degree").orderBy("vec_id")) - 1
    return n.withColumn("place", place).join(counts.select("degree", offset.alias("offset")), "degree").select("vec_id", "degree", (F.col("offset") + F.col("place")).alias("place"))


def break_up_labels(points: DataFrame, most: int) -> DataFrame:
    """vec_id, dummy (0: the point itself), labels: points of more than ``most`` labels become several of at most that many."""
    each = points.select("vec_id", F.posexplode("labels").alias("i", "label")).withColumn("dummy", F.floor(F.col("i") / most))
    return each.groupBy("vec_id", "dummy").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda s: s["label"]).alias("labels"))


def label_entries(labelled: DataFrame, entries: DataFrame) -> DataFrame:
    """label, entries: entry points of the parts, for each label a part has. labelled: label, part_id; entries: part_id, entry."""
    return labelled.select("label", "part_id").distinct().join(entries, "part_id").groupBy("label").agg(F.array_sort(F.collect_set("entry")).alias("entries"))
