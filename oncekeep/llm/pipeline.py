"""Stages of the corpus pipeline: each takes and returns documents, the last one packed pieces."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import small
from ..session import FREE_SHUFFLES
from . import language, near_copies, packing, quality, simhash, substring_automata
from .common import DOCUMENT_COLUMNS, numbered, written

# Near copies: word shingles and their Jaccard similarity.
SHINGLE = 5
SIMILARITY = 0.8
# Differing bits within which fingerprints link, as in op9.
MAX_BITS = 2


def hamming_radius(similarity: float, bits: int = simhash.BITS) -> int:
    """Differing bits that a Jaccard similarity lets expect: the angle of two sets, in bits, rounded."""
    cosine = 2 * similarity / (1 + similarity)
    return round(bits * math.acos(cosine) / math.pi)


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents of ``rows`` (stored, numbered by ``_row``) whose number is in ``keys``."""
    return rows.join(keys, "_row", "left_semi").select(*DOCUMENT_COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    return numbered(docs, "_row", DOCUMENT_COLUMNS)


def _freeing(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` in a session that deletes the shuffle files of each finished query."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(FREE_SHUFFLES, "true")
        return stage(spark, docs, sf_dir)

    return run


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; a null or empty text is too short and goes."""
    return quality.kept_documents(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that ``language.identify`` keeps: the text has letters, is not in a language unlike all known ones, and one has at least half of the probability.

    ``lang`` is both the label of the training sample and the declared language, ``source`` stands
    for the host. A row of the sample is judged without its own trigrams, and what is declared cannot save a text that no known language explains. Where no row
    has a label no language is known, and no document stays.
    """
    rows = _numbered(docs)
    model = language.fit_text_model(rows.select("_row", "text", "lang"), "_row")
    evidence = language.document_evidence(rows, "_row")
    if model.trained is not None:
        evidence = evidence.join(small(model.trained, "trained"), "_row", "left")
    told = language.identify(evidence, model, ["_row"])
    return _only(rows, told.filter("kept").select("_row"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies.

    Documents link where the sets of their five-word shingles have a Jaccard similarity of 0.8 or
    more, verified for every link. Fingerprint groups come first, then what the prefix filter finds beyond them. Of repeated rows one stays. Texts without words are copies of each other.
    """
    rows = _numbered(docs)
    later = near_copies.later_copies(rows.select(F.col("_row").alias("id"), "text"), SHINGLE, SIMILARITY, MAX_BITS)
    return rows.join(small(later.withColumnRenamed("id", "_row"), "later-copies"), "_row", "left_anti").select(*DOCUMENT_COLUMNS)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words and more that stand anywhere else; n_chars follows the text.

    Every document stays, also one of which nothing is left: its text is then empty.
    """
    docs = docs if docs.columns == DOCUMENT_COLUMNS else docs.select(*DOCUMENT_COLUMNS)
    kept = substring_automata.remove_repeated_passages(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*DOCUMENT_COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", _freeing(quality_stage)),
    ("language_id", _freeing(language_stage)),
    ("simhash_dedup", _freeing(near_copy_stage)),
    ("substring_dedup", _freeing(passage_stage)),
    ("best_fit_packing", _freeing(packing_stage)),
]

# Fingerprint components and tokens are beyond plain SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads the stored result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
