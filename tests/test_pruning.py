"""Bound-and-prune search: same rows as full scoring, fewer pairs scored, k rows per task and query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pruning
from tessera.operators import search as SR

VECS = "article_id long, vecs array<array<float>>"
QUERY = "query_id long, tok_no long, vec array<float>"


def _full(articles, queries, k):
    """Distance of every pair, then the k best per query."""
    dist = SR.article_query_distances(articles, queries)
    return {tuple(r) for r in SR.ranked_order(SR.topk_closest(dist, k), None).collect()}


def _tables(spark, rng, topics, articles, spread, copies=0, parts=2):
    centres = rng.normal(0, 1, (topics, 16))
    rows = []
    for i in range(articles):
        topic = centres[rng.integers(topics)]
        rows.append((i, (topic + rng.normal(0, spread, (rng.integers(1, 9), 16))).astype(np.float32).tolist()))
    rows += [(articles + i, rows[i][1]) for i in range(copies)]  # ties
    rows.append((10 ** 6, []))
    queries = [(q, t, (centres[q % topics] + rng.normal(0, spread, 16)).astype(np.float32).tolist()) for q in range(12) for t in range(3)]
    return (spark.createDataFrame(rows, VECS).repartition(parts).cache(), spark.createDataFrame(queries, QUERY).cache())


@pytest.mark.parametrize("topics,spread,k", [(12, 0.02, 5), (12, 0.3, 3), (1, 1.0, 7), (3, 0.0, 4)])
def test_same_rows_as_full_scoring(spark, monkeypatch, topics, spread, k):
    monkeypatch.setattr(pruning, "PAUSE", 2)
    monkeypatch.setattr(pruning, "CHUNK", 30)
    arts, queries = _tables(spark, np.random.default_rng(topics), topics, 300, spread, copies=40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # many batches in a task
    try:
        got = SR.nearest_articles(arts, queries, k).collect()
        want = SR.ranked_order(SR.topk_closest(SR.article_query_distances(arts, queries), k)).collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) == 12 * k
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clustered_articles_are_mostly_not_scored(spark):
    arts, queries = _tables(spark, np.random.default_rng(5), 40, 2000, 0.02, parts=1)
    scored, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        rows = SR.article_query_distances(arts, queries, k=5, counters=(scored, seen)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen.value == 12 * 2000 and scored.value < seen.value / 4 and len(rows) == 60


def test_scored_articles_below_half():
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (40, 16))
    X = np.round((centres[np.arange(2000) % 40] + rng.normal(0, .02, (2000, 16))) * 1e6)
    Q = np.round(centres[:4] * 1e6)
    payload = {"Qu": Q, "inv": np.arange(4), "starts": np.array([0, 2]), "counts": np.array([2, 2]), "query_ids": np.array([0, 1])}
    best = pruning.RunningTopK(payload, 5, SR.TILE_ELEMENTS, SR.BATCH_CELLS, SR._partial_sq_dist, SR.MICRO, SR.PICO)
    for a in range(0, 2000, 250):  # an article is one token; its topic is its id modulo 40
        best.add(np.arange(a, a + 250), X[a:a + 250], np.arange(250), np.ones(250, np.int64))
    assert best.seen_articles == 2000 and best.scored_articles < 500


def test_a_task_sends_its_best_once(spark):
    arts, queries = _tables(spark, np.random.default_rng(2), 5, 500, 0.1, parts=3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        sent = (SR.article_query_distances(arts, queries, k=4).groupBy(F.spark_partition_id().alias("p"), "query_id").count().collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(sent) == 3 * 12 and {r["count"] for r in sent} == {4}


def test_components_that_are_no_numbers_come_last(spark):
    arts = spark.createDataFrame([(1, [[float("nan"), 1.0]]), (2, [[0.0, 1.0]]), (3, [[5.0, 1.0], [float("nan"), 2.0]]), (4, [[0.0, 2.0]])], VECS).coalesce(1)
    queries = spark.createDataFrame([(0, 0, [0.0, 1.0])], QUERY)
    got = [r.article_id for r in SR.nearest_articles(arts, queries, 2).collect()]
    assert got == [2, 4]
    assert {r.article_id for r in SR.nearest_articles(arts, queries, 9).collect()} == {1, 2, 3, 4}


def test_blocks_one_after_another(spark):
    arts, queries = _tables(spark, np.random.default_rng(3), 6, 200, 0.1)
    whole = {tuple(r) for r in SR.nearest_articles(arts, queries, 5).collect()}
    assert {tuple(r) for r in SR.nearest_articles(arts, queries, 5, max_block_bytes=3000).collect()} == whole


@pytest.mark.parametrize("scale", [1.0, 1e13])
def test_shared_vectors_beyond_one_table_are_bounded_by_blocks(monkeypatch, scale):
    rng = np.random.default_rng(3)
    X = np.round(rng.normal(0, 1, (300, 8)) * 1e6 * scale)
    Q = X[rng.integers(0, 300, 24)] + np.round(rng.normal(0, 1e3, (24, 8)))
    payload = {"Q": Q, "Qu": Q, "inv": np.arange(24), "starts": np.arange(0, 24, 3), "counts": np.full(8, 3), "dim": 8,
               "query_ids": np.arange(8)}
    counts = rng.integers(1, 30, 600)
    row_of = rng.integers(0, 300, int(counts.sum()))
    monkeypatch.setattr(pruning, "CHUNK", 50)

    def best(cells):
        found = pruning.RunningTopK(payload, 4, 1000, cells, SR._partial_sq_dist, SR.MICRO, SR.PICO)
        found.add(np.arange(600), X, row_of, counts)
        return found

    one, blocks = best(10 ** 6), best(100)
    assert one.real.all() and (one.ids == blocks.ids).all() and (one.dist == blocks.dist).all()
    if scale == 1.0:
        assert blocks.scored < blocks.seen / 4
