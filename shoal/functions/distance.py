"""Distances between array columns, as expressions that stay in the JVM and accumulate in doubles from left to right.

Squared L2 has no root; the inner-product distance is 1 - <a, b> and may be negative. Integer vectors use the same expressions, which are
exact for them. ``KERNELS`` has the same measures for matrices of a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _d(x: Column) -> Column:
    return x.cast("double")


def l2_sq(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))))


def inner_product(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def mips_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - inner_product(a, b)


def norm_sq(a: Column) -> Column:
    return _fold(F.transform(a, lambda x: _d(x) * _d(x)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - inner_product(a, b) / (F.sqrt(norm_sq(a)) * F.sqrt(norm_sq(b)))


def to_int8(a: Column, scale: int = 127) -> Column:
    return F.transform(a, lambda x: F.floor(_d(x) * scale).cast("tinyint"))


def to_uint8(a: Column, scale: int = 127) -> Column:
    """Values 0 to 255 as smallint, which has room for them."""
    return F.transform(a, lambda x: F.floor((_d(x) + 1) * scale).cast("smallint"))


def padded(a: Column, multiple: int) -> Column:
    """Zeros appended up to a length that is a multiple."""
    missing = F.pmod(-F.size(a), F.lit(multiple))
    return F.concat(a, F.array_repeat(F.lit(0).cast("float"), missing))


def residual(a: Column, center: Column) -> Column:
    return F.zip_with(a, center, lambda x, y: _d(x) - _d(y))


def augmented(a: Column, largest_norm: Column) -> Column:
    """MIPS to L2: the vector over the largest norm, and a component that makes its norm 1."""
    rest = F.greatest(F.lit(1.0) - norm_sq(a) / (largest_norm * largest_norm), F.lit(0.0))
    return F.concat(F.transform(a, lambda x: _d(x) / largest_norm), F.array(F.sqrt(rest)))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2_sq, "ip": inner_product, "mips": mips_distance, "cosine": cosine_distance}


def _l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"l2": _l2, "mips": lambda a, b: 1 - a @ b.T, "cosine": _cosine}


def register(spark: SparkSession) -> None:
    """SQL functions l2_sq, inner_product, mips_distance and cosine_distance over arrays, as SQL bodies (no UDF)."""
    dot = "aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v)"
    bodies = {
        "l2_sq": "aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, v) -> s + v)",
        "inner_product": dot.format(a="a", b="b"),
        "mips_distance": "1D - " + dot.format(a="a", b="b"),
        "cosine_distance": "1D - " + dot.format(a="a", b="b") + " / (sqrt(" + dot.format(a="a", b="a") + ") * sqrt(" + dot.format(a="b", b="b") + "))",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A random rotation: an orthogonal matrix, the same for a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(vectors, dim: int, seed: int = 0, back: bool = False):
    """``vectors`` (vec_id, embedding) turned by the rotation of the seed, or ``back`` again."""
    turn = rotation(dim, seed)
    turn = turn if back else turn.T

    def run(batches):
        for b in batches:
            if len(b):
                yield b.assign(embedding=list(np.array(b["embedding"].tolist(), float) @ turn))

    return vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id long, embedding array<double>")
