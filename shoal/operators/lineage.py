"""Cutting lineage by Parquet files in the folder that all executors share.

Not by ``DataFrame.checkpoint``: that keeps the plan's estimated size, which a loop of joins multiplies from step to step until the estimates
themselves, numbers of as many digits as 2 to the power of the steps, take all the time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and Spark is one process, as in tests."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="shoal-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written and read again, so that its lineage and its estimated size end there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes what ``cut`` has written of ``df``, which can't be read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("cut-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
