"""Session helpers: building a session, reading the test tables, shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # text rows are small but CPU-heavy per row: keep post-shuffle partitions modest
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # nested token vectors make rows large; keep Arrow batches bounded
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    # Arrow buffers live in direct memory (bounded by the heap size): keep batches small
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024 * 1024),
    "spark.driver.memory": "8g",  # only used when this module starts the JVM (local runs)
}


def get_spark(master: str | None = None, app: str = "tessera",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the library defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


# corpus tables carry the per-row text work; spread them when they arrive too thin
CORPUS_TABLES = ("documents", "conversations", "pages")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in every Python worker (``addPyFile`` of a zip).

    Functions passed to Arrow/pandas UDFs are pickled by reference to ``tessera``; the zip
    travels with the job like ``--py-files``, whatever the workers' working directory.
    """
    import shutil

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="tessera-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "tessera"), "zip", os.path.dirname(pkg_dir), "tessera")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in CORPUS_TABLES else df


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is read as given. Only when it is
    unset in local mode (tests) do we point it at a fresh local folder; elsewhere an unset
    folder is an error, as executors would write to their own disks.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not sc.master.startswith("local") or sc.master.startswith("local-cluster") and not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new, unique path under the shared checkpoint folder (never reused)."""
    root = checkpoint_root(spark)
    path = f"{root}/tessera-{tag}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list = []


def discard_scratch(spark: SparkSession) -> int:
    """Deletes every scratch path that this driver has handed out; returns how many there were.

    Results are read lazily from their scratch tables, so call it when they have been used.
    """
    n = 0
    while _SCRATCH:
        p = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a thin input over the cluster before costly per-row work.

    A large input already arrives in many partitions and is left alone (no shuffle); only an
    input with fewer partitions than the cluster's task slots is spread out. Call it on a
    scan (no exchange below), where counting partitions plans but runs nothing.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


SPLITS_A_TASK = 32  # of small files


def packed(df: DataFrame) -> DataFrame:
    """A scan of very many small files in fewer tasks, each of which reads several splits: a split holds
    a few files only, since Spark counts the opening of one as 4 MB. Call it on a scan, like ``spread``."""
    n = df.rdd.getNumPartitions()
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-n // SPLITS_A_TASK))
    return df.coalesce(tasks) if n > tasks else df
