"""Vector tables: (vec_id long, embedding array<float>), checked at ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_vectors(vectors: DataFrame, column: str = "embedding") -> int:
    """The common length of all vectors; raises where one is null, ragged, empty or has a null component. One pass, one row to the driver."""
    v = F.col(column)
    bad = v.isNull() | (F.size(v) <= 0) | F.exists(v, lambda x: x.isNull())
    r = vectors.agg(F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi"), F.count(F.when(bad, 1)).alias("bad")).first()
    if r["bad"] or r["lo"] != r["hi"]:
        raise ValueError(f"{r['bad']} vectors are null or incomplete; lengths {r['lo']} to {r['hi']}")
    return r["lo"] or 0
