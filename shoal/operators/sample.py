"""Seeded sampling; the same seed gives the same rows whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chance(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) for each key: multiplicative hashing, which any SQL engine can repeat."""
    return F.pmod(key.cast("decimal(38,0)") * F.lit(2654435761) + F.lit(seed), F.lit(1 << 32)).cast("double") / float(1 << 32)


def bernoulli(rows: DataFrame, rate: float, seed: int = 0, key: str = "vec_id") -> DataFrame:
    """Each row with probability ``rate`` (clipped to 1)."""
    return rows.where(chance(F.col(key), seed) < min(rate, 1.0))


def of_size(rows: DataFrame, target: int, seed: int = 0, key: str = "vec_id") -> DataFrame:
    """About ``target`` rows: the rate is target over the table's count."""
    return bernoulli(rows, target / max(1, rows.count()), seed, key)


def random_vectors(spark, n: int, dim: int, seed: int = 0, low: int = -128, high: int = 127) -> DataFrame:
    """n vectors of uniform integers, for warm-up."""
    parts = [F.floor(F.rand(seed + i) * (high - low + 1) + low).cast("float") for i in range(dim)]
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(*parts).alias("embedding"))


def amplified(queries: DataFrame, times: int = 10) -> DataFrame:
    """The query set ``times`` over, with new ids: copy c of query i is c * n + i."""
    n = queries.count()
    copies = queries.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn("query_id", F.col("_copy") * F.lit(n) + F.col("query_id")).drop("_copy")
