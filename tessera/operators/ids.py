"""Dense sequence ids 0, 1, 2, ... in a given order, computed in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequence_ids(df: DataFrame, order_cols: list, id_col: str = "seq_id") -> DataFrame:
    """Add ``id_col`` = 0-based rank of each row in ``order_cols`` order (dense, no gaps).

    A global ``row_number()`` would run in one task. Instead: range-sort, tag every row with
    its partition and its increasing position inside the partition, and write that to a
    table in the shared ``spark.checkpoint.dir`` (this cuts the lineage, so the two passes
    below agree even if executors are lost and work is redone). Then count rows per
    partition (one small row per partition), turn the counts into offsets and add each
    row's position inside its partition.
    """
    from ..session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, "seq")
    (df.orderBy(*order_cols)
     .withColumn("_pid", F.spark_partition_id())
     .withColumn("_mono", F.monotonically_increasing_id())
     .write.parquet(path))
    tagged = spark.read.parquet(path)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # one row per partition: a bounded broadcast
    return (tagged.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
            .withColumn(id_col, (F.col("_off") + F.col("_mono") - F.col("_first")).cast("long"))
            .drop("_pid", "_mono", "_off", "_first"))
