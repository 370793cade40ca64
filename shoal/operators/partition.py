"""Partitions of a vector table: by ranges of ids, by clusters with replicas, and the positions that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.exact import nearest_centers


def range_parts(vectors: DataFrame, parts: int) -> DataFrame:
    """vec_id, part_id by contiguous ranges of ids 0 .. n - 1; the last part takes the remainder."""
    size = max(1, vectors.count() // parts)
    return vectors.select("vec_id", F.least(F.floor(F.col("vec_id") / size), F.lit(parts - 1)).cast("long").alias("part_id"))


def forced_equal_parts(positions: DataFrame, parts: int) -> DataFrame:
    """pos, part_id with sizes of n div parts + 1, the last what is left."""
    return positions.select("pos", F.floor(F.col("pos") / (positions.count() // parts + 1)).alias("part_id"))


def part_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("part_id").agg(F.count("*").alias("n"))


def position_map(assigned: DataFrame) -> DataFrame:
    """vec_id, part_id, pos: rows numbered from 0 by (part_id, vec_id), without one sort of all: ranks within buckets of a part, on offsets from counts."""
    bucketed = assigned.select("vec_id", "part_id", F.floor(F.col("vec_id") / 65536).alias("bucket"))
    counts = bucketed.groupBy("part_id", "bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("part_id", "bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 65536 ids of a part
    offsets = counts.select("part_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part_id", "bucket").orderBy("vec_id")
    ranked = bucketed.withColumn("place", F.row_number().over(within) - 1)
    return ranked.join(offsets, ["part_id", "bucket"]).select("vec_id", "part_id", (F.col("offset") + F.col("place")).alias("pos"))


def owner_of(positions: DataFrame, sizes: DataFrame) -> DataFrame:
    """pos, part_id from the parts' cumulative sizes: a range lookup in a table of one row a part."""
    upto = F.sum("n").over(Window.orderBy("part_id").rowsBetween(Window.unboundedPreceding, 0))
    bounds = sizes.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("n"))
    lists = bounds.agg(F.array_sort(F.collect_list(F.struct("hi", "part_id"))).alias("bounds")).first()["bounds"]
    part = F.lit(None).cast("long")
    for b in reversed(lists):
        part = F.when(F.col("pos") < b["hi"], F.lit(b["part_id"])).otherwise(part)
    return positions.select("pos", part.alias("part_id"))


def replica_parts(points: DataFrame, centers: DataFrame, replicas: int = 2) -> DataFrame:
    """vec_id, replica_rank, part_id, dist: rank 0 owns the row, further ranks are its next nearest parts."""
    near = nearest_centers(points, centers, replicas)
    return near.select("vec_id", (F.col("rank") - 1).alias("replica_rank"), "part_id", "dist")


def membership(assigned: DataFrame) -> DataFrame:
    """vec_id, parts: its parts, the owner first."""
    return assigned.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("replica_rank", "part_id"))), lambda s: s["part_id"]).alias("parts"))


def retrieve(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """The vectors of every part: one join for all parts."""
    return assigned.join(vectors, "vec_id")


def reordered(vectors: DataFrame, positions: DataFrame) -> DataFrame:
    """pos and all columns of ``vectors``, range-sorted by position."""
    return positions.select("vec_id", "pos").join(vectors, "vec_id").orderBy("pos")


def reorder_differences(ordered: DataFrame, vectors: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows that a reordering lost, made up or put at another position; empty if it is right."""
    want = vectors.join(positions.select("vec_id", "pos"), "vec_id").select(*ordered.columns)
    return ordered.exceptAll(want).unionByName(want.exceptAll(ordered))


def part_labels(labelled: DataFrame, assigned: DataFrame) -> DataFrame:
    """part_id, vec_id, labels: the labels of every part's rows (``labelled``: vec_id, labels); a row of several parts is in each."""
    return assigned.select("part_id", "vec_id").distinct().join(labelled, "vec_id").select("part_id", "vec_id", "labels")


def write_parts(vectors: DataFrame, assigned: DataFrame, path: str) -> None:
    retrieve(vectors, assigned).repartition("part_id").write.mode("overwrite").partitionBy("part_id").parquet(path)


def routes(candidates: DataFrame, parts: int, rule: str = "share") -> DataFrame:
    """query_id, part_id, n, share, primary, leader from coarse candidates (query_id, part_id).

    The leader is the part with most candidates (ties to the smaller id). Rules: ``share``: primary if the share exceeds
    1 / parts, and the leader where no part does; ``any``: every part with a candidate.
    """
    counts = candidates.groupBy("query_id", "part_id").agg(F.count("*").alias("n"))
    of_query = Window.partitionBy("query_id")
    r = counts.withColumn("share", F.col("n") / F.sum("n").over(of_query))
    r = r.withColumn("leader", F.row_number().over(of_query.orderBy(F.desc("n"), "part_id")) == 1)
    over = F.col("share") > F.lit(1.0 / parts)
    primary = F.lit(True) if rule == "any" else over | (F.col("leader") & (F.max(over.cast("int")).over(of_query) == 0))
    return r.select("query_id", "part_id", "n", "share", primary.alias("primary"), "leader")
