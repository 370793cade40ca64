"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows in a batch for Python.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where it is unset and Spark is one process (tests), a temporary one."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("shoal.shared.dir", None)
    if not folder:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shoal-")
        spark.conf.set("shoal.shared.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so that its lineage ends there."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with batches of bounded bytes, whatever the length of the texts (a longer text is a batch of its own)."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


_kept: dict = {}


def kept(key, make):
    """What a worker keeps from task to task: one thing, the last asked for, so that what operators keep doesn't add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def packed(docs: DataFrame, *keys, carry: list[str] | None = None) -> DataFrame:
    """Every column of ``docs``, or those of ``carry``, in one struct ``_row`` beside ``keys``, so that no name can clash."""
    return docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("_row"), *keys)


def texts_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def slices(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is a range of its own."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > size:
            yield lo, k
            lo, held = k, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)
