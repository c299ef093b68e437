"""Metadata cleaning: first row per abstract, then rows with a null dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import FILE_ORDER, METADATA_COLUMNS


def dedup_keep_first(df: DataFrame, subset: str = "abstract", order_cols: list = FILE_ORDER) -> DataFrame:
    """One row per ``subset`` value, the first in ``order_cols`` order; nulls form one group.

    ``row_number() = 1`` (planned with a partial group limit before the shuffle), not
    ``dropDuplicates``, which does not promise the first row. A hot value costs one row per
    input partition after the partial limit.
    """
    w = Window.partitionBy(subset).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def drop_null_rows(df: DataFrame, columns: list[str] = METADATA_COLUMNS) -> DataFrame:
    """Drop a row if any of ``columns`` is null (``dropna()``)."""
    return df.na.drop("any", subset=columns)


def metadata_clean(df: DataFrame, columns: list[str] = METADATA_COLUMNS,
                   order_cols: list = FILE_ORDER) -> DataFrame:
    """``dedup_keep_first`` then ``drop_null_rows``, in this order: a group whose first row
    has a null vanishes altogether (the null filter must stay above the window)."""
    return drop_null_rows(dedup_keep_first(df, "abstract", order_cols), columns)


def head_rows(df: DataFrame, order_cols: list = FILE_ORDER, n: int = 5) -> DataFrame:
    """First ``n`` rows in file order (a top-n: ``TakeOrderedAndProject``)."""
    return df.orderBy(*order_cols).limit(n)
