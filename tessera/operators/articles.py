"""Article text from the nested JSON record (built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import has_text, py_strip


def _texts(arr: Column) -> Column:
    return F.transform(arr, lambda x: x["text"])


def full_abstract(abstract: Column) -> Column:
    """Abstract texts joined by ``\\n``; ``''`` when absent."""
    return F.coalesce(F.array_join(_texts(abstract), "\n"), F.lit(""))


def full_text(body_text: Column) -> Column:
    """Body texts joined by ``\\n``; ``''`` when absent."""
    return F.coalesce(F.array_join(_texts(body_text), "\n"), F.lit(""))


def concat_text(abstract: Column, body_text: Column) -> Column:
    """``strip(abstract + '\\n' + body)`` if ``body_text`` is present, else ``''`` (even with an
    abstract, as in the reference)."""
    return F.when(body_text.isNull(), F.lit("")).otherwise(
        py_strip(F.concat(full_abstract(abstract), F.lit("\n"), full_text(body_text))))


def fold_name_part(part: Column) -> Column:
    """A name part that is a string, or a list of strings (read as JSON text) joined by spaces."""
    return F.when(part.startswith("["), F.array_join(F.from_json(part, "array<string>"), " ")).otherwise(part)


def author_names(authors: Column) -> Column:
    """``first middle last`` per author (an empty middle leaves two spaces); authors joined by
    ``\\n``; ``''`` when there are none. Null parts are skipped."""
    one = F.transform(authors, lambda a: F.concat_ws(" ", fold_name_part(a["first"]),
                                                     fold_name_part(a["middle"]), fold_name_part(a["last"])))
    return F.coalesce(F.array_join(one, "\n"), F.lit(""))


def article_text(articles: DataFrame) -> DataFrame:
    """Adds ``full_abstract``, ``full_text`` and ``concat_text``."""
    return articles.select(
        "*",
        full_abstract(F.col("abstract")).alias("full_abstract"),
        full_text(F.col("body_text")).alias("full_text"),
        concat_text(F.col("abstract"), F.col("body_text")).alias("concat_text"))


def article_record(articles: DataFrame) -> DataFrame:
    """The six output columns ``(paper_id, concat_text, title, full_abstract, authors, full_text)``."""
    return articles.select(
        F.col("paper_id"),
        concat_text(F.col("abstract"), F.col("body_text")).alias("concat_text"),
        F.col("metadata.title").alias("title"),
        full_abstract(F.col("abstract")).alias("full_abstract"),
        author_names(F.col("metadata.authors")).alias("authors"),
        full_text(F.col("body_text")).alias("full_text"))


def drop_empty_articles(df: DataFrame, text_col: str = "concat_text") -> DataFrame:
    """Drop articles without text before any costly work (embedding)."""
    return df.filter(has_text(F.col(text_col)))
