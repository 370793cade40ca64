"""The registered queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark, sf_dir):
    from shoal.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_lm_scoring(spark, sf_dir):
    from shoal.llm.ppm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark, sf_dir):
    from shoal.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_exact_top_k(spark, sf_dir):
    from shoal.llm.covertree import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark, sf_dir):
    from shoal.llm.toxicity import score_toxicity

    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select("_row.doc_id", F.element_at("p", 1).alias("p_junk"), F.element_at("p", 2).alias("p_toxic"), "toxic")


def op6_bpe_round_trip(spark, sf_dir):
    from shoal.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_quality(spark, sf_dir):
    from shoal.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("_row.doc_id", "votes", "weak", "score", "keep")


def op8_license_scan(spark, sf_dir):
    from shoal.llm.licences import licence_report

    return licence_report(table(spark, sf_dir, "documents"))


def op9_token_files(spark, sf_dir):
    from shoal.llm.tokenfile import read_shards, write_shards

    return read_shards(write_shards(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op10_learned_partitions(spark, sf_dir):
    from shoal.llm.partitions import approximate_top_k

    return approximate_top_k(table(spark, sf_dir, "embeddings"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op")}


#: Vectors that take part, in whole 64ths; every pair of a query and another row.
EXACT_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM v q, v d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql():
    """Of what SQL can express: the other operators need hashes, tokenizers or trained models."""
    return {"op4_exact_top_k": EXACT_TOP_K}
