"""Streaming top-k after a replayed micro-batch; dense sequence ids across partitions."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF
from tessera.session import scratch_path


def test_replayed_batch_gives_the_same_state(spark):
    from tessera.sources.derived import articles_from_long, vector_search_inputs
    from tessera.streaming import topk as STR
    art_long, queries = vector_search_inputs(spark, SF)
    arts = articles_from_long(art_long).select("article_id", "vecs")
    src, state, ckpt = scratch_path(spark, "t-src"), scratch_path(spark, "t-state"), scratch_path(spark, "t-ckpt")
    arts.repartition(3).write.parquet(src)
    first = sorted(tuple(r) for r in STR.stream_topk(spark, src, queries, state, ckpt, k=10).collect())
    # lose the commit of the last micro-batch, as if the driver died after writing its state
    commits = os.path.join(ckpt.replace("file:", ""), "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    os.remove(os.path.join(commits, str(last)))
    crc = os.path.join(commits, f".{last}.crc")  # the local file system's checksum twin
    if os.path.exists(crc):
        os.remove(crc)
    again = sorted(tuple(r) for r in STR.stream_topk(spark, src, queries, state, ckpt, k=10).collect())
    from tessera.plans.search import search_vectors
    batch = sorted(tuple(r) for r in search_vectors(spark, SF).collect())
    assert first == again == batch


def test_sequence_ids_dense_over_many_partitions(spark):
    from tessera.operators.ids import sequence_ids
    df = spark.range(0, 5000, 1, 13).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id").alias("v"))
    got = sequence_ids(df.repartition(9), ["k", "v"], "seq")
    want = df.withColumn("seq", F.row_number().over(Window.orderBy("k", "v")) - 1)
    assert sorted(tuple(r) for r in got.select("k", "v", "seq").collect()) == \
        sorted(tuple(r) for r in want.select("k", "v", F.col("seq").cast("long")).collect())
