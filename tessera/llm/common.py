"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package, spread

#: white space between words in every operator here: space and U+0009..U+000D
SPACE = r"[\x20\x09-\x0D]+"
#: bound of what may be sent to every executor as model data (vocabulary files)
MAX_MODEL_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, spread over the cluster if it arrives too thin."""
    ship_package(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def written(df: DataFrame, tag: str, group_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: cuts the lineage, so a
    lost executor costs a re-read, and everything above sees the very same rows.

    ``group_rows``: rows of a Parquet row group, for rows of megabytes. Spark reads up to 4,096 rows of
    a row group at once, and Parquet's writer looks at the size of what it holds every 100 rows.
    """
    path = scratch_path(df.sparkSession, tag)
    writer = df.write.option("compression", "zstd")
    if group_rows is not None:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a string of its own for every row, and that column's name.

    Rows of Parquet files are named by their file and their place in it, which any re-read
    gives again; other tables are written once with numbered rows. Verdicts on rows are taken by
    this name, so null ids and ids that several rows share are judged row by row.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    # only plans that give each row of a file at most once
    nodes = set(re.findall(r"(?m)^[ :+\-]*(\w+)", docs._jdf.queryExecution().analyzed().toString()))
    try:
        if not nodes <= {"Project", "Filter", "Repartition", "RepartitionByExpression", "SubqueryAlias", "Relation"}:
            raise AnalysisException("rows may have come more than once")
        place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
        rows = docs.withColumn(name, place)
        rows.schema  # is there such a column?
        return rows, name
    except AnalysisException:
        return written(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "rows"), name


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null or empty: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def utf8(column: pa.Array) -> list:
    """The texts of an Arrow string column as UTF-8 ``bytes`` (null: ``b""``)."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if b is None else b for b in column.cast(kind).to_pylist()]


_MADE: dict = {}


def per_worker(key: tuple, make: Callable):
    """``make()`` once per Python worker and key (a module-level cache, found by import)."""
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


class ModelFile:
    """A vocabulary file read on the driver and sent along with the tasks, size-checked, so
    that executors need no copy of it on their own disks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read(MAX_MODEL_BYTES + 1)
        if len(self.data) > MAX_MODEL_BYTES:
            raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
        self.name = path.rsplit("/", 1)[-1]
        self.key = hashlib.sha256(self.data).hexdigest()


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file (default of the path parameters)."""
    import public_tokenizers
    return public_tokenizers.path(name)


class TwoGenerationCache(dict):
    """A bounded memo: when it holds ``limit`` new entries, those asked for again are kept
    and the others go. Forgetting costs time only, never a different answer."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def lookup(self, key):
        """The value of ``key`` or None; an old entry that is asked for again stays."""
        value = self.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self[key] = value
        return value

    def rotate(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
