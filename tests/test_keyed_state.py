"""Keyed streaming state: replayed batches and restarts give the batch answer."""

import os

import numpy as np
import pytest

from tessera.operators import search as SR
from tessera.session import scratch_path
from tessera.streaming import topk as STR

VECS = "article_id long, vecs array<array<float>>"


@pytest.fixture
def tables(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.integers(0, 4, (rng.integers(1, 4), 3)).astype(float).tolist()) for i in range(120)]  # many ties
    queries = spark.createDataFrame([(q, t, rng.integers(0, 4, 3).astype(float).tolist()) for q in range(5) for t in range(2)],
                                    "query_id long, tok_no long, vec array<float>")
    return spark.createDataFrame(rows, VECS), queries


def _want(arts, queries, k=4):
    return sorted(map(tuple, SR.nearest_articles(arts, queries, k).collect()))


def test_batches_and_restart_equal_the_batch_answer(spark, tables):
    arts, queries = tables
    src, ckpt = scratch_path(spark, "in"), scratch_path(spark, "ckpt")
    arts.limit(0).write.parquet(src)
    assert STR.stream_topk_keyed(spark, src, queries, ckpt, k=4).count() == 0
    for part in range(3):  # each run is a restart on the same checkpoint
        arts.filter(f"article_id % 3 = {part}").repartition(2).write.mode("append").parquet(src)
        got = STR.stream_topk_keyed(spark, src, queries, ckpt, k=4, max_files_per_trigger=1, state_partitions=3)
        assert sorted(map(tuple, got.collect())) == _want(arts.filter(f"article_id % 3 <= {part}"), queries)
    again = STR.stream_topk_keyed(spark, src, queries, ckpt, k=4)  # nothing new
    assert sorted(map(tuple, again.collect())) == _want(arts, queries)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_replayed_batch_counts_once(spark, tables):
    """The last commit is lost after its batch was done: the batch runs again on the state before it."""
    arts, queries = tables
    src, ckpt = scratch_path(spark, "in"), scratch_path(spark, "ckpt")
    arts.repartition(4).write.parquet(src)
    first = STR.stream_topk_keyed(spark, src, queries, ckpt, k=4, max_files_per_trigger=1, state_partitions=2).collect()
    commits = os.path.join(ckpt, "0-of-1", "commits").removeprefix("file:")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    os.remove(os.path.join(commits, str(last)))
    crc = os.path.join(commits, f".{last}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    again = STR.stream_topk_keyed(spark, src, queries, ckpt, k=4, max_files_per_trigger=1)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first)) == _want(arts, queries)
    assert os.path.exists(os.path.join(commits, str(last)))


def test_several_query_blocks(spark, tables):
    arts, queries = tables
    src, ckpt = scratch_path(spark, "in"), scratch_path(spark, "ckpt")
    arts.repartition(2).write.parquet(src)
    got = STR.stream_topk_keyed(spark, src, queries, ckpt, k=4, max_block_bytes=150, state_partitions=2)
    assert sorted(map(tuple, got.collect())) == _want(arts, queries)
    assert len(os.listdir(ckpt.removeprefix("file:"))) > 1
