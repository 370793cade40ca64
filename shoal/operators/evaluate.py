"""Evaluation: recall, sweeps over ef, and access statistics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EFS = (3, 4, 5, 6, 8, 10, 15, 20, 30, 40, 50, 70, 100, 150, 200, 250, 300, 400, 500, 600, 700)


def recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """hits, total, recall over all queries; both tables have query_id, rank, vec_id."""
    t = truth.where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("want"))
    r = result.where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("got")).distinct()
    return t.join(r, ["query_id", "vec_id"], "left").agg(F.count("got").alias("hits"), F.count("*").alias("total")).select("hits", "total", (F.col("hits") / F.col("total")).alias("recall"))


def ef_sweep(search: Callable[[int], DataFrame], truth: DataFrame, k: int, efs=EFS) -> list[tuple[int, float, float, float]]:
    """ef, recall, seconds a query, queries a second."""
    out, n = [], truth.select("query_id").distinct().count()
    for ef in efs:
        t = time.time()
        found = search(ef)
        r = recall(found, truth, k).first()["recall"]
        s = time.time() - t
        out.append((ef, r, s / max(1, n), n / s))
    return out


def write_sweep(spark, rows: list[tuple[int, float, float, float]], path: str) -> None:
    spark.createDataFrame(rows, "ef int, recall double, latency double, qps double").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def access_ranks(accessed: DataFrame) -> DataFrame:
    """place, n, share: rows that queries read from their most used part, second most, and so on. accessed: query_id, part_id."""
    per = accessed.groupBy("query_id", "part_id").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "part_id")).cast("long")
    ranked = per.withColumn("place", place).groupBy("place").agg(F.sum("c").alias("n"))
    return ranked.select("place", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def hop_histogram(lengths: DataFrame, edges=(0, 50, 100, 150, 200, 300, 400, 500, 600)) -> DataFrame:
    """bucket (its lower edge), n of path lengths (column ``hops``)."""
    bucket = F.lit(None).cast("int")
    for lo in edges:
        bucket = F.when(F.col("hops") >= lo, F.lit(lo)).otherwise(bucket)
    return lengths.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def locality(placed: DataFrame) -> DataFrame:
    """src_part, local, remote, share of edges that stay in their part."""
    local = F.sum((F.col("src_part") == F.col("dst_part")).cast("long"))
    return placed.groupBy("src_part").agg(local.alias("local"), (F.count("*") - local).alias("remote"), (local / F.count("*")).alias("share"))


def part_switches(path: DataFrame) -> DataFrame:
    """query_id, switches, runs: how often a path (query_id, step, part_id) changes part."""
    last = F.lag("part_id").over(Window.partitionBy("query_id").orderBy("step"))
    return path.withColumn("last", last).groupBy("query_id").agg(F.sum((F.col("part_id") != F.col("last")).cast("long")).alias("switches"))
