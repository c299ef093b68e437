"""Registry of named queries over the test tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import flow_queries, model_queries, search, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "search_vectors": search.search_vectors,
        "search_articles": search.search_articles,
        **text_queries.QUERIES,
        **model_queries.QUERIES,
        **flow_queries.QUERIES,
    }
