"""A corpus pipeline: documents that are good and not toxic, one of each near-duplicate group, mixed to target weights, as token ids.

STAGES are applied in order; each takes (spark, docs, sf_dir), and its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents; the last returns, for each row of the mix, the other columns with
n_tokens, ids and exact (decoding the ids gives the text again). A column of documents that has one of these names goes on as ``documents_`` and
its name.

Defined cases: null, empty and white-space texts have no words and go as junk; texts of any length are whole; rows without doc_id are documents like others; of
rows that tie in everything one stays; a null source is a source of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.bpe import encode_documents
from shoal.llm.common import stash, table
from shoal.llm.minhash import drop_similar
from shoal.llm.mixing import mix_documents
from shoal.llm.quality import score_quality
from shoal.llm.queries import vocabulary
from shoal.llm.toxicity import score_toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score_quality(docs).where("keep").select("_row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("not toxic").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs, words=5, least=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = [F.size("ids").cast("long").alias("n_tokens"), F.col("ids"), F.col("exact")]
    names = {c: f"documents_{c}" if c in ("n_tokens", "ids", "exact") else c for c in docs.columns if c != "text"}
    carried = [F.col("_row")[c].alias(name) for c, name in names.items()]
    return encode_documents(docs, vocabulary("byte_bpe_50k.json")).select(*carried, *made)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: The trained stages can't be expressed in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
