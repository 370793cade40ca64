"""Filter labels: a text file with a line for each point, its labels comma-separated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_labels(line: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(line), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """vec_id (line number), labels. A line's number follows from the lines of the blocks before it, so each file is read as one split."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("vec_id", "line"))
    return lines.select(F.col("vec_id").cast("long"), parse_labels(F.col("line")).alias("labels"))
