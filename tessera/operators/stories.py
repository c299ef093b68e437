"""Story files -> story lines and summary lines (built-in expressions, no Python)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import join_summary, story_lines, story_part, summary_part


def process_story(df: DataFrame, raw_col: str = "raw_story") -> DataFrame:
    """Adds ``story_lines`` (before the first ``@highlight``) and ``summary_lines`` (after it,
    markers dropped). Lines are stripped, empty ones dropped, missing periods added."""
    lines = story_lines(F.col(raw_col))
    return (df.withColumn("_lines", lines)
            .withColumn("story_lines", story_part(F.col("_lines")))
            .withColumn("summary_lines", summary_part(F.col("_lines")))
            .drop("_lines"))


def drop_empty_stories(df: DataFrame) -> DataFrame:
    return df.filter(F.size("story_lines") > 0)


def with_reference_summary(df: DataFrame) -> DataFrame:
    """``tgt_str``: the summary lines joined by a space."""
    return df.withColumn("tgt_str", join_summary(F.col("summary_lines")))


def count_documents(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_documents"))
