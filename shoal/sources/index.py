"""Indexes kept as Parquet: written once, searched many times.

An index is a folder with a table for each of its kinds: ``vectors`` (vec_id, embedding), ``positions`` (vec_id, part_id, pos), ``edges`` (src, dst),
``graphs`` (part_id, vec_id, neighbors, entry), ``layout``, ``top`` (vec_id, embedding), ``centers`` (part_id, center). Tables with a part_id are stored by part, so
that a search of one part reads no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KINDS = ("vectors", "positions", "edges", "graphs", "layout", "top", "centers")


def _checked(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"an index has {', '.join(KINDS)}, no {kind}")
    return kind


def write_index(path: str, append: bool = False, **tables: DataFrame) -> None:
    """Writes tables of an index; ``append`` adds rows to what is there, else they replace it."""
    for kind, table in tables.items():
        writer = table.write.mode("append" if append else "overwrite")
        if "part_id" in table.columns and kind != "centers":
            writer = writer.partitionBy("part_id")
        writer.parquet(f"{path}/{_checked(kind)}")


def read_index(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table of an index; its part_id is a long, as it was written."""
    table = spark.read.parquet(f"{path}/{_checked(kind)}")
    return table.withColumn("part_id", table["part_id"].cast("long")) if "part_id" in table.columns else table
