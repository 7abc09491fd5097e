"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import FREE_SHUFFLES
from . import collocations, language, packing, quality, rp_forest, sentence_pieces, sharding, simhash, spelling
from . import substring_arrays, substring_automata, token_counts, url_filter
from .common import SPACE, table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_text_model(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return language.identify_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_pieces.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set(FREE_SHUFFLES, "true")
    return rp_forest.link_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = sharding.Added(shard=40, weight=1.0, region=1, rack=3)
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.even_tree(2, 4, 5), new)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_automata.remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), f"{SPACE}+"), "")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_arrays.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_sharding": op5_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_url_filters": op8_url_filters,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_token_counts": op13_token_counts,
}
