"""End-to-end search: texts -> token vectors -> nearest articles per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.articles import drop_empty_articles
from ..operators.embed import InTask, LookupEncoder, distinct_word_tokens, embed_tokens, first_vector_per_token, token_vectors, word_tokens
from ..operators.search import mean_best_distance, min_distance_long, nearest_articles, ranked_order, topk_closest
from ..session import read_table
from ..sources.derived import articles_from_long, text_articles, text_queries, vector_search_inputs

K = 10  # articles kept per query
SEQ_LENGTH = 128  # tokens per window of a text, [CLS] and [SEP] included


def search_vectors(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """Top-k on given token vectors (no model): the minimal search slice."""
    article_tokens, queries = vector_search_inputs(spark, sf_dir)
    return nearest_articles(articles_from_long(article_tokens), queries, k=k)


def lookup_encoder(spark: SparkSession, sf_dir: str) -> LookupEncoder:
    return LookupEncoder(read_table(spark, sf_dir, "embeddings"), vec_col="embedding", order_col="vec_id")


def text_tokens(texts: DataFrame, key_col: str) -> DataFrame:
    """``(key, tokens)``: the encoder's tokens of each text."""
    return texts.select(key_col, word_tokens(F.col("text"), SEQ_LENGTH).alias("tokens"))


def embed_texts(texts: DataFrame, encoder: LookupEncoder, key_col: str, in_task: bool = False) -> DataFrame | InTask:
    """``(key, tokens, vecs)``: the encoder's tokens of each text and one vector per token."""
    return embed_tokens(text_tokens(texts, key_col), encoder, "tokens", "vecs", in_task=in_task)


def query_vectors(queries: DataFrame, encoder: LookupEncoder) -> DataFrame:
    """Query matrix: one vector per distinct query token, first occurrence."""
    return first_vector_per_token(embed_texts(queries, encoder, "query_id"), "query_id")


def search_texts(articles: DataFrame, queries: DataFrame, encoder: LookupEncoder, k: int = K) -> DataFrame:
    """``article_text`` -> ``drop_empty_articles`` -> ``embed_tokens`` -> distances -> top-k.

    The article side carries only its distinct token ids; the encoder's gather runs inside the scoring
    task, so one Arrow round trip per batch and no vectors materialised as rows.
    """
    arts = drop_empty_articles(articles, "text").select(
        "article_id", encoder.token_ids(distinct_word_tokens(F.col("text"))).alias("tok_ids"))
    return nearest_by_token_ids(arts, query_vectors(queries, encoder), encoder, k)


def nearest_by_token_ids(articles: DataFrame, query_vecs: DataFrame, encoder: LookupEncoder, k: int) -> DataFrame:
    """Top-k for articles given as token ids ``(article_id, tok_ids)``: gathered in the scoring
    task from a broadcast table, or, for a table beyond the bound, joined to it and scored
    as long rows. Both give the same rows."""
    if encoder.fits:
        encoder.broadcast(articles.sparkSession)
        return nearest_articles(articles, query_vecs, k=k, vecs_col="tok_ids", encoder=encoder)
    minima = min_distance_long(token_vectors(articles, encoder, "article_id"), query_vecs)
    return ranked_order(topk_closest(mean_best_distance(minima), k))


def search_articles(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """Flagship: benchmark queries against the documents corpus, 10 nearest per query."""
    enc = lookup_encoder(spark, sf_dir)
    return search_texts(text_articles(spark, sf_dir), text_queries(spark, sf_dir), enc, k)
