"""A training corpus from ``documents``: quality rules, near-copy removal, repeated passages,
source mixing, SentencePiece ids. Each stage's rows are written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, quality, sentence_pieces, simhash, substring_dedup
from tessera.llm.common import table, tokenizer_path
from tessera.session import scratch_path


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs certified for their language."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 4-word fingerprints link at 4 or fewer bits."""
    return simhash.drop_near_copies(docs, shingle=4, max_bits=4)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings of 100 and more that came up earlier."""
    return _recounted(substring_dedup.remove_repeats(docs, length=100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, a part taken once more as a row of its own."""
    return _recounted(mixing.mix(docs))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text of every row."""
    out = sentence_pieces.encode_digests(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources", mix_sources),
    ("sentencepiece encoding", sentencepiece_ids),
]

#: XXH64, the tokenizer and the suffix arrays have no SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
