"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, cross_tokenizer, embedding_dedup, exact_dedup, mixing, oracles, page_text, periodic_runs, quality, sentence_pieces, simhash, substring_dedup, token_counts, token_files
from .common import table, tokenizer_path


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page (converted from ARC), written as archives and read back."""
    out = archives.archive_pages(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page under the wrapper of its host."""
    out = page_text.main_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under ``word_bpe_49k.json``, written as token files and read back."""
    out = token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return out.withColumnRenamed("id", "doc_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 4-word shingles, links at 4 or fewer differing bits."""
    out = simhash.near_copy_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component").alias("component_id"))


def op5_sentencepiece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests, under ``piece_bpe_32k.model``."""
    out = sentence_pieces.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict under cutoffs certified per language."""
    out = quality.quality_verdicts(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.98 and more between all embeddings of equal label."""
    out = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix of sources weighing 3, 1, 2, ... takes."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under ``byte_bpe_50k.json``."""
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without its repeats of 100 bytes and more."""
    return substring_dedup.remaining(table(spark, sf_dir, "documents"), length=100).withColumnRenamed("id", "doc_id")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens under ``byte_bpe_50k.json`` and ``piece_bpe_32k.model``."""
    out = cross_tokenizer.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                tokenizer_path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal after lower-casing A-Z, and the row of each that stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, repetition planted in one of ten."""
    return periodic_runs.run_digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_html_main_text": op2_html_main_text,
    "op3_token_id_files": op3_token_id_files,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_sentencepiece_encoding": op5_sentencepiece_encoding,
    "op6_quality_rules": op6_quality_rules,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = oracles.ORACLES
