"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, langid, mixing, packing, ppm, repeats, simhash, spelling, tokencounts, topk, toxicity, warc, whitening
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", mixing.domain_of_source().alias("domain"), "lang", "source", mixing.word_tokens("text").alias("n_tokens"))
    return mixing.mix(counted, mixing.LEVELS, mixing.WEIGHTS, share=0.7, epochs=2, seed=17)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle_words=4, max_distance=4)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.section_tokens(table(spark, sf_dir, "documents"), tokencounts.head_body_tail("text"), rule="majority")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("text", F.lower("lang").alias("lang")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_mix_sources, op2_simhash_near_dedup, op3_token_counts, op4_toxicity, op5_lm_scoring,
            op6_embedding_near_dedup, op7_exact_top_k, op8_language_id, op9_packing, op10_warc_derivatives,
            op11_embedding_whitening, op12_spelling_variants, op13_suffix_dedup,
        )
    }


TOP_K_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score, c.r AS cr FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.oracle_sql(share=0.7, epochs=2, seed=17), "op7_exact_top_k": TOP_K_SQL, "op10_warc_derivatives": warc.oracle_sql()}
