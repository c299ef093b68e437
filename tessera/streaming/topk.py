"""Incremental top-k over arriving files (Structured Streaming).

``stream_topk_keyed`` keeps the k best of every query as keyed state (``transformWithState``): a
micro-batch reads and writes the state of the queries that it has candidates for, and nothing
else; Spark versions, commits and restores that state with the checkpoint.

``stream_topk`` (``foreachBatch``) is the form for plans that keyed state can't follow, such as
an encoder table beyond the broadcast bound, whose join needs an aggregate of its own.
Its state is a versioned Parquet table under a shared folder: version ``v`` is built only from
the latest complete version before ``v`` and micro-batch ``v``, then written with
overwrite. A batch replayed after a failure rewrites the same version from the same
inputs, so the result is exactly-once; a restarted query resumes from its checkpoint and
keeps the state it had. Nothing is lost between saves (the state is written every batch).
The last two versions are kept. State that cannot be read, or is missing although the
checkpoint counts files as done, is an error, never an empty start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.articles import article_record
from ..operators.embed import token_vectors
from ..operators.search import (DEFAULT_QUERY_BLOCK_BYTES, DIST_SCHEMA, article_query_distances, broadcast_block,
                                mean_best_distance, min_distance_long, query_blocks, ranked_order, topk_closest,
                                topk_kernel, written)
from ..sources.files import ARTICLE_SCHEMA

STATE_COLS = ["query_id", "article_id", "distance"]
VECTOR_ARTICLES = T.StructType([T.StructField("article_id", T.LongType()),
                                T.StructField("vecs", T.ArrayType(T.ArrayType(T.FloatType())))])
TOKEN_ID_ARTICLES = T.StructType([T.StructField("article_id", T.LongType()),
                                  T.StructField("tok_ids", T.ArrayType(T.LongType()))])


KEPT_VERSIONS = 2  # a replayed batch needs the version before its own


def _folder(spark: SparkSession, path: str):
    """The store that holds ``path``, and ``path`` in it (whatever Spark itself can reach)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, state_dir: str) -> set[int]:
    """Complete state versions on storage (read once per run, then tracked in the driver).

    No folder means no state yet; any other trouble is raised. A version whose write did not
    end (no ``_SUCCESS``) does not count.
    """
    fs, root = _folder(spark, state_dir)
    if not fs.exists(root):
        return set()
    found = set()
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.add(int(name[2:]))
    return found


def _has_commits(spark: SparkSession, checkpoint_dir: str) -> bool:
    fs, commits = _folder(spark, f"{checkpoint_dir}/commits")
    return fs.exists(commits) and any(s.getPath().getName().isdigit() for s in fs.listStatus(commits))


def _drop_old(spark: SparkSession, state_dir: str, versions: set[int]) -> None:
    for v in sorted(versions)[:-KEPT_VERSIONS]:
        fs, old = _folder(spark, f"{state_dir}/v={v}")
        fs.delete(old, True)
        versions.discard(v)


def _state_version(spark: SparkSession, state_dir: str, v: int) -> DataFrame:
    return spark.read.parquet(f"{state_dir}/v={v}").select(*STATE_COLS)


def read_state(spark: SparkSession, state_dir: str) -> DataFrame | None:
    versions = _versions(spark, state_dir)
    return _state_version(spark, state_dir, max(versions)) if versions else None


def merge_topk(previous: DataFrame | None, batch_topk: DataFrame, k: int) -> DataFrame:
    """Union the kept rows with a batch's best, dedupe by (query, article), keep k per query."""
    cur = batch_topk.select(*STATE_COLS)
    if previous is not None:
        cur = cur.unionByName(previous.select(*STATE_COLS))
    cur = cur.dropDuplicates(["query_id", "article_id"])
    return topk_closest(cur, k).select(*STATE_COLS)


def stream_topk(spark: SparkSession, source_dir: str, queries: DataFrame, state_dir: str, checkpoint_dir: str,
                k: int = 10, max_files_per_trigger: int = 1000, schema: T.StructType = VECTOR_ARTICLES,
                fmt: str = "parquet", encoder=None) -> DataFrame:
    """Run the running top-k over every file in ``source_dir`` not seen by ``checkpoint_dir``.

    ``queries``: ``(query_id, tok_no, vec)``; the source holds ``(article_id, vecs)``, or with
    a token-wise ``encoder`` ``(article_id, tok_ids)`` (the encoder runs in the scoring task).
    Returns the current result ``(query_id, rank, article_id, distance)``.
    """
    if encoder is not None:
        schema = TOKEN_ID_ARTICLES
        if encoder.fits:
            encoder.broadcast(spark)

    versions = _versions(spark, state_dir)  # one listing per run; batches then add theirs
    if not versions and _has_commits(spark, checkpoint_dir):
        raise RuntimeError(f"{checkpoint_dir} counts files as done, but {state_dir} holds no complete state")

    def merge(batch_df: DataFrame, batch_id: int) -> None:
        vecs_col = "tok_ids" if encoder is not None else "vecs"
        if encoder is not None and not encoder.fits:  # the table is joined, not broadcast
            near = mean_best_distance(min_distance_long(token_vectors(batch_df, encoder, "article_id"), queries))
        else:
            near = article_query_distances(batch_df, queries, k=k, vecs_col=vecs_col, encoder=encoder)
        best = topk_closest(near, k)
        earlier = [v for v in versions if v < batch_id]
        prev = _state_version(spark, state_dir, max(earlier)) if earlier else None
        out = merge_topk(prev, best, k)
        out.write.mode("overwrite").parquet(f"{state_dir}/v={batch_id}")
        versions.add(batch_id)
        _drop_old(spark, state_dir, versions)

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .format(fmt).load(source_dir))
    q = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if not versions:  # nothing has arrived yet
        state = spark.createDataFrame([], "query_id long, article_id long, distance double")
    else:
        state = _state_version(spark, state_dir, max(versions))
    return ranked_order(topk_closest(state, k))


#: the state of a query: its best articles, nearest first, the later id first among equals
BEST = "article_ids array<long>, distances array<double>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BestArticles(StatefulProcessor):
    """The ``k`` best articles of each query (key ``query_id``) over all batches so far.

    Emits a query's rows whenever they change. An article that arrives again counts once, with
    its smallest distance.
    """

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", BEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        old = self.best.get()
        known = list(zip(old[1], old[0])) if old is not None else []
        best = known
        for part in rows:  # each part is folded in at once: never more than k of the past are held
            nearest: dict = {}
            for d, i in [*best, *zip(part["distance"].tolist(), part["article_id"].tolist())]:
                if i not in nearest or not nearest[i] <= d:
                    nearest[i] = d
            best = sorted(((d, i) for i, d in nearest.items()), key=lambda x: (x[0] != x[0], x[0], -x[1]))[:self.k]
        if best != known:
            self.best.update(([i for _, i in best], [d for d, _ in best]))
            yield pd.DataFrame({"query_id": key[0], "article_id": [i for _, i in best], "distance": [d for d, _ in best]})

    def close(self) -> None:
        pass


class _Settings:
    """Session settings that hold while a streaming query is started (it copies them then)."""

    def __init__(self, spark: SparkSession, **settings):
        self.spark, self.settings = spark, settings

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def stream_topk_keyed(spark: SparkSession, source_dir: str, queries: DataFrame, checkpoint_dir: str, k: int = 10,
                      max_files_per_trigger: int = 1000, schema: T.StructType = VECTOR_ARTICLES, fmt: str = "parquet",
                      encoder=None, state_partitions: int | None = None,
                      max_block_bytes: int = DEFAULT_QUERY_BLOCK_BYTES) -> DataFrame:
    """The running top-k with keyed state: ``(query_id, rank, article_id, distance)`` over every file
    that ``checkpoint_dir`` has seen, after taking in those that it has not.

    Articles are scored where they are read; a task sends its ``k`` best per query once, which are
    dealt by ``query_id`` to the state. A batch that is replayed after a failure starts from the
    state version before it, so each file counts once. The number of state
    partitions (default: the task slots) is fixed at the first start. Query blocks beyond
    ``max_block_bytes`` are streams of their own, one after another, each with its own checkpoint; they
    start anew if the queries no longer give the same blocks.
    """
    if encoder is not None:
        if not encoder.fits:
            raise ValueError("an encoder table beyond the broadcast bound needs stream_topk")
        encoder.broadcast(spark)
        schema = TOKEN_ID_ARTICLES
    gather = encoder.gather_fn() if encoder is not None else None
    parts = str(state_partitions or spark.sparkContext.defaultParallelism)
    thin = max_files_per_trigger < spark.sparkContext.defaultParallelism  # a batch's files may be fewer than the task slots
    states = []
    for name, block in query_blocks(queries, max_block_bytes):
        bc = broadcast_block(block)
        if bc is None:
            continue
        folder = f"{checkpoint_dir}/{name}"
        arrived = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).format(fmt).load(source_dir))
        if thin:  # articles are dealt to all task slots
            arrived = arrived.repartition(int(parts))
        near = arrived.mapInArrow(topk_kernel(bc, k, gather), DIST_SCHEMA)
        changed = near.groupBy("query_id").transformWithStateInPandas(BestArticles(k), DIST_SCHEMA, "Update", "None")
        with _Settings(spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": parts}):
            q = (changed.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder)
                 .trigger(availableNow=True).start())
            q.awaitTermination()
            if _has_commits(spark, folder):
                states.append(written(keyed_state(spark, folder), "state"))
        bc.destroy()
    if not states:  # nothing has arrived yet
        return ranked_order(topk_closest(spark.createDataFrame([], DIST_SCHEMA), k))
    out = states[0]
    for more in states[1:]:
        out = out.unionByName(more)
    return ranked_order(topk_closest(out, k))


def keyed_state(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """``(query_id, article_id, distance)`` as the state store of one stream holds them."""
    state = spark.read.format("statestore").option("path", checkpoint_dir).option("stateVarName", "best").load()
    best = F.explode(F.arrays_zip(F.col("value.article_ids"), F.col("value.distances"))).alias("b")
    return (state.select(F.col("key.query_id").alias("query_id"), best)
            .select("query_id", F.col("b.article_ids").alias("article_id"), F.col("b.distances").alias("distance")))


def stream_articles(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
                    glob: str = "*.json", multi_line: bool = True, max_files_per_trigger: int = 1000,
                    mode: str = "FAILFAST") -> DataFrame:
    """Read articles as they arrive (in any sub-folder), build the article record, append to a
    Parquet table. A malformed file stops the stream (its batch is not counted as done)."""
    stream = (spark.readStream.schema(ARTICLE_SCHEMA).option("mode", mode).option("multiLine", multi_line)
              .option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files_per_trigger).json(source_dir))
    q = (article_record(stream).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)
