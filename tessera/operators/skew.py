"""Joins whose frequent keys are found by a count, broadcast, and kept out of the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: a key of this share of all rows or more is hot: there are at most 1 / SHARE such keys
SHARE = 1 / 1000
#: slack of the share: keys are kept from a share less by 1 / COUNTERS
COUNTERS = 4000


def heavy_hitters(df: DataFrame, key: str, share: float = SHARE, counters: int = COUNTERS) -> list:
    """Every key of at least ``share`` of the rows (null apart), and perhaps some of slightly less.

    One pass over the key column: rows are counted by key where they are read, then by key over all
    tasks (Spark's aggregate, which spills). What comes to the driver are at most
    1 / (share - 1 / counters) keys.
    """
    column = F.col(key).cast("long" if isinstance(df.schema[key].dataType, T.IntegralType) else "string").alias("key")
    counted = df.select(column).groupBy("key").agg(F.count(F.lit(1)).alias("n"))  # shuffled once for both uses
    rows = counted.agg(F.sum("n").alias("rows"))
    found = (counted.join(F.broadcast(rows), F.col("n") >= (share - 1 / counters) * F.col("rows"))
             .filter(F.col("key").isNotNull()).orderBy(F.desc("n")))
    return [r["key"] for r in found.select("key", "n").collect()]


def join_with_hot_keys(big: DataFrame, small: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """``big`` left join ``small`` on ``key``, one row of ``small`` per key at most.

    Rows of hot and of null keys meet the few rows of ``small`` for hot keys where they are read;
    only the others are shuffled, and no key among those has more than ``share`` of the rows.
    ``big`` is computed three times (count, hot rows, other rows).
    """
    hot = heavy_hitters(big, key, share)
    if not hot:
        return big.filter(F.col(key).isNotNull()).join(small, key, "left").unionByName(
            big.filter(F.col(key).isNull()).join(F.broadcast(small.limit(0)), key, "left"))
    spark = big.sparkSession
    keys = spark.createDataFrame([(k,) for k in hot], f"{key} {'long' if isinstance(hot[0], int) else 'string'}")
    few = small.join(F.broadcast(keys), key, "left_semi")  # at most 1 / share rows
    marked = F.broadcast(keys.withColumn("_hot", F.lit(True)))
    tagged = big.join(marked, key, "left")
    here = tagged.filter(F.col("_hot") | F.col(key).isNull()).drop("_hot").join(F.broadcast(few), key, "left")
    rest = tagged.filter(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot").join(small, key, "left")
    return here.unionByName(rest)
