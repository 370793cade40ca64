"""Vectors in blocks, for searches of a query set against all rows.

Queries and data are cut into blocks of bounded size (a hot partition becomes many blocks); a task gets one block of
queries with one block of data, and the best of all blocks are merged by a grouped window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block, about.
DATA_ROWS, QUERY_ROWS = 8192, 8192


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part: not null, not empty, without null or non-finite components."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select("vec_id", v.alias("v")).where("v is not null and size(v) > 0 and vec_id is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = rows.where(~F.coalesce(bad, F.lit(True)))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """The query rows; of rows that repeat a vec_id, the smallest vector is the query."""
    return rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all blocks, ties to smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched(queries: DataFrame, data: DataFrame, search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple], score_type: str, k: int) -> DataFrame:
    """Joins blocks of queries and data by their key (``pair``: array of their blocks) and searches each pair.

    ``search(query ids, query vectors, ids, vectors)`` gives arrays of query positions, data positions and scores; a column ``floor`` of the queries is its fifth argument.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        more = [left["floor"].to_numpy()] if "floor" in left else []
        q, d, scores = search(left["vec_id"].to_numpy(), matrix(left["v"]), right["vec_id"].to_numpy(), matrix(right["v"]), *more)
        return pd.DataFrame({"query_id": left["vec_id"].to_numpy()[q], "vec_id": right["vec_id"].to_numpy()[d], "score": scores})

    queries, data = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (queries, data))  # both may come of one table
    pairs = queries.groupBy("pair").cogroup(data.groupBy("pair")).applyInPandas(run, f"query_id long, vec_id long, score {score_type}")
    return best(pairs, k)
