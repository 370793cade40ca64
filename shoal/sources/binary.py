"""Vector benchmark files: a header of two little-endian 32-bit counts (rows, dimension), then the values row by row.

``.fbin`` holds 32-bit floats, ``.u8bin`` and ``.i8bin`` bytes, ``.ibin`` 32-bit ids. The row number is the id. The reader is a
Python data source (``format("vecbin")``) that plans byte ranges of a file, so a large file is many tasks; executors open the
path, which has to be on storage they share. Ground truth is rows x k ids, then, optionally, as many float distances.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"fbin": ("<f4", "float"), "u8bin": ("u1", "smallint"), "i8bin": ("i1", "tinyint"), "ibin": ("<u4", "bigint")}
ARROW = {"float": pa.float32(), "smallint": pa.int16(), "tinyint": pa.int8(), "bigint": pa.int64()}
HEADER = 8
RANGE_BYTES = 64 << 20


def kind_of(path: str) -> tuple[np.dtype, str]:
    kind = path.rpartition(".")[2]
    if kind not in KINDS:
        raise ValueError(f"not one of {', '.join(KINDS)}: {path}")
    return np.dtype(KINDS[kind][0]), KINDS[kind][1]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def read_header(path: str) -> tuple[int, int]:
    """Rows and dimension."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        n, dim = np.frombuffer(f.read(HEADER), "<u4").tolist()
    if dim == 0:
        raise ValueError(f"no dimension: {path}")
    return n, dim


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self) -> str:
        return f"vec_id long, embedding array<{kind_of(self.options['path'])[1]}>"

    def reader(self, schema) -> DataSourceReader:
        return VectorReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


class Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class VectorReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path = path
        self.kind, self.type = kind_of(path)
        self.n, self.dim = read_header(path)
        fs, at = opened(path)
        if fs.get_file_info(at).size < HEADER + self.n * self.dim * self.kind.itemsize:
            raise ValueError(f"shorter than its header says: {path}")
        self.step = max(1, range_bytes // (self.dim * self.kind.itemsize))

    def partitions(self) -> list[InputPartition]:
        return [Rows(lo, min(self.n, lo + self.step)) for lo in range(0, self.n, self.step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, at = opened(self.path)
        width, rows = self.dim * self.kind.itemsize, max(1, (4 << 20) // (self.dim * self.kind.itemsize))
        with fs.open_input_file(at) as f:
            for lo in range(partition.lo, partition.hi, rows):
                hi = min(partition.hi, lo + rows)
                f.seek(HEADER + lo * width)
                values = pa.array(np.frombuffer(f.read((hi - lo) * width), self.kind)).cast(ARROW[self.type])
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * self.dim + 1, self.dim), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), vectors], ["vec_id", "embedding"])


def read_vectors(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(VectorFiles)
    return spark.read.format("vecbin").options(path=path, **options).load()


def read_queries(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """query_id, embedding of the first n rows."""
    q = read_vectors(spark, path).withColumnRenamed("vec_id", "query_id")
    return q if n is None else q.where(F.col("query_id") < n)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """place, vec_id from a file of one column of ids (.ibin)."""
    n, dim = read_header(path)
    if dim != 1:
        raise ValueError(f"an id map has one column, not {dim}: {path}")
    return read_vectors(spark, path).select(F.col("vec_id").alias("place"), F.col("embedding")[0].alias("vec_id"))


def read_ground_truth(spark: SparkSession, path: str, k: int, with_distances: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id[, dist] of the first k of each query's neighbours. A file of bounded size (queries x k) read by one task."""
    n, width = read_header(path)
    fields = "query_id long, rank int, vec_id long" + ", dist float" * with_distances

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            fs, at = opened(path)
            with fs.open_input_file(at) as f:
                f.seek(HEADER)
                ids = np.frombuffer(f.read(4 * n * width), "<u4").reshape(n, width)[:, :k]
                dists = np.frombuffer(f.read(4 * n * width), "<f4").reshape(n, width)[:, :k] if with_distances else None
            q, r = np.indices(ids.shape)
            arrays = [pa.array(q.ravel().astype(np.int64)), pa.array((r.ravel() + 1).astype(np.int32)), pa.array(ids.ravel().astype(np.int64))]
            names = ["query_id", "rank", "vec_id"]
            if with_distances:
                arrays.append(pa.array(dists.ravel()))
                names.append("dist")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return spark.range(1).repartition(1).mapInArrow(run, fields)


def read_graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """vec_id, neighbors of a proximity-graph file, and its entry point. Header: bytes u64, largest degree u32, entry u32, frozen u64; then each
    node's degree u32 and neighbours u32. Lists are ragged, so one task scans them."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        head = f.read(24)
    size, entry = int.from_bytes(head[:8], "little"), int.from_bytes(head[12:16], "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            fs, at = opened(path)
            with fs.open_input_file(at) as f:
                data, p, lists = np.frombuffer(f.read(size)[24:], "<u4"), 0, []
            while p < len(data):
                d = int(data[p])
                lists.append(data[p + 1 : p + 1 + d].astype(np.int64))
                p += d + 1
            yield pa.RecordBatch.from_arrays([pa.array(range(len(lists)), pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["vec_id", "neighbors"])

    return spark.range(1).repartition(1).mapInArrow(run, "vec_id long, neighbors array<long>"), entry


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Writes (vec_id 0 .. n - 1, embedding) as one file: the header first, then each task its own byte range by way of a file
    of its rows, which are joined in order. The path has to be a folder that executors share."""
    kind, _ = kind_of(path)
    parts = path + ".parts"
    fs, at = opened(parts)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, dim, blobs = None, 0, 0, []
        for b in batches:
            if b.num_rows:
                first = b.column(0)[0].as_py() if first is None else first
                values = np.asarray(b.column(1).flatten()).astype(kind)
                n, dim = n + b.num_rows, len(values) // b.num_rows
                blobs.append(values.tobytes())
        if n:
            fs, at = opened(f"{parts}/{first:020d}")
            with fs.open_output_stream(at) as f:
                for x in blobs:
                    f.write(x)
            yield pa.RecordBatch.from_pylist([{"first": first, "n": n, "dim": dim}])

    ordered = vectors.select("vec_id", "embedding").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    written = sorted(ordered.mapInArrow(run, "first long, n long, dim long").collect())  # a row for each task
    fs, at = opened(path)
    with fs.open_output_stream(at) as out:
        out.write(np.array([sum(w["n"] for w in written), written[0]["dim"] if written else 0], "<u4").tobytes())
        for w in written:
            with opened(f"{parts}/{w['first']:020d}")[0].open_input_stream(opened(f"{parts}/{w['first']:020d}")[1]) as f:
                while chunk := f.read(8 << 20):
                    out.write(chunk)
    fs.delete_dir(opened(parts)[1])


def write_ground_truth(result: DataFrame, path: str, k: int) -> None:
    """Writes query_id, rank, vec_id as rows of k ids (``result`` has k rows for each of queries 0 .. n - 1)."""
    lists = result.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("embedding"))
    write_vectors(lists.select(F.col("query_id").alias("vec_id"), F.slice("embedding", 1, k).alias("embedding")), path)
