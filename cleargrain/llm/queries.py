"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.llm.common import read_table, split_of
from cleargrain.llm.html_extract import extract_pages
from cleargrain.llm.langid import fit_languages, identify_languages
from cleargrain.llm.mixing import MIX_SQL, mix_sources
from cleargrain.llm.neardup import NEAR_DUP_SQL, link_vectors
from cleargrain.llm.ngram_join import NGRAM_SQL, join_ngrams
from cleargrain.llm.packing import pack_documents
from cleargrain.llm.pii import digest_spans, find_spans, fit_segments
from cleargrain.llm.prefix_trie import PREFIX_TRIE_SQL, prefix_trie
from cleargrain.llm.quality import fit_quality, score_quality
from cleargrain.llm.sharding import SHARD_SQL, shard_documents
from cleargrain.llm.topk import TOP_K_SQL, quantise, search_top_k
from cleargrain.llm.toxicity import fit_toxicity, score_toxicity
from cleargrain.llm.vector_codes import VECTOR_CODES_SQL, compress_vectors


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read_table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit_languages(docs))
    return found.select("doc_id", (split_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "n_words")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (split_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(read_table(spark, sf_dir, "embeddings"))
    return search_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (split_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches", "matched"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return digest_spans(find_spans(docs, fit_segments(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_personal_data": op13_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": NEAR_DUP_SQL,
    "op4_sharding": SHARD_SQL,
    "op6_mixing": MIX_SQL,
    "op8_exact_top_k": TOP_K_SQL,
    "op9_ngram_jaccard_join": NGRAM_SQL,
    "op11_prefix_trie": PREFIX_TRIE_SQL,
    "op12_vector_codes": VECTOR_CODES_SQL,
}
