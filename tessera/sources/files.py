"""File sources and sinks: article JSON, metadata CSV, pair lines, story files, vocabulary."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import py_strip, split_pair_a, split_pair_b, story_lines, story_part, summary_part
from ..operators.ids import sequence_ids
from ..session import packed

# Article JSON (one article per file). ``middle`` may be a string or a list of strings in the
# data; declared as string, a list arrives as its JSON text and is folded later.
NAME_PART = T.StringType()
AUTHOR = T.StructType([T.StructField("first", NAME_PART), T.StructField("middle", NAME_PART),
                       T.StructField("last", NAME_PART)])
TEXT_ENTRY = T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))
ARTICLE_SCHEMA = T.StructType([
    T.StructField("paper_id", T.StringType()),
    T.StructField("metadata", T.StructType([T.StructField("title", T.StringType()),
                                            T.StructField("authors", T.ArrayType(AUTHOR))])),
    T.StructField("abstract", TEXT_ENTRY),
    T.StructField("body_text", TEXT_ENTRY),
])

# The metadata columns that are read
METADATA_COLUMNS = ["title", "abstract", "authors", "doi", "publish_time"]

# a folder of very many files that Spark writes is put in place by the tasks that wrote them; by default the driver moves
# every file when all are done, one after another
MANY_FILES = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}

# The strings pandas.read_csv reads as missing by default
PANDAS_NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                    "nan", "null"]


def write_one_per_file(df: DataFrame, column: str, path: str) -> None:
    """Each row's text and a line feed as a ``.txt`` file of its own directly in ``path``.

    A task writes into a folder of its attempt and puts its files in place at its end, under names that a second
    attempt takes too. Spark's writer starts several processes for every local file (its permissions are set
    by a command), so tasks write those themselves; other stores are left to it.
    """
    spark = df.sparkSession
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = store.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        df.select(column).write.options(**MANY_FILES).option("maxRecordsPerFile", 1).text(path)
        return
    if fs.exists(store):
        raise FileExistsError(path)
    folder = store.toUri().getPath()

    def write(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        own, n = f"{folder}/_task-{task.partitionId()}-{task.taskAttemptId()}", 0
        os.makedirs(own)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                with open(f"{own}/{n}", "wb") as f:
                    f.write((text.as_py() or b"") + b"\n")
                n += 1
        for i in range(n):
            os.replace(f"{own}/{i}", f"{folder}/part-{task.partitionId():05d}-{i:07d}.txt")
        os.rmdir(own)
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    fs.mkdirs(store)
    df.select(column).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def with_file_order(df: DataFrame) -> DataFrame:
    """Add the ``FILE_ORDER`` columns: sorting by them gives the order rows have in the files.

    Within one split rows are read in file order, so the increasing row id orders them; the
    file path and split start order the splits.
    """
    return df.select("*", F.length("_metadata.file_path").alias("_file_length"), F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_row"))


# part numbers of any width sort as numbers: shorter paths come first
FILE_ORDER = ["_file_length", "_file", "_block", "_row"]


def scan_article_json(spark: SparkSession, root: str, multi_line: bool = True, glob: str = "*.json",
                      mode: str = "FAILFAST") -> DataFrame:
    """Every ``*.json`` below ``root`` (recursive), one article per file, explicit schema.

    The schema prunes nested fields at the scan; no inference pass over the corpus. A
    malformed file is an error; with ``mode="PERMISSIVE"`` it becomes a row whose
    ``_corrupt_record`` holds its text (null on good rows), never an empty article unseen.
    """
    schema = ARTICLE_SCHEMA if mode == "FAILFAST" else T.StructType(
        ARTICLE_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    found = (spark.read.schema(schema)
             .option("multiLine", multi_line)
             .option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob)
             .option("mode", mode)
             .json(root)
             .select("*", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_name").alias("document_name")))
    return packed(found) if multi_line else found


def scan_article_bodies(spark: SparkSession, root: str, multi_line: bool = True, glob: str = "*.json") -> DataFrame:
    """Stories from article bodies: ``(document_name, paper_id, story_lines, summary_lines)``.

    The raw story is the body texts joined by ``\\n`` (missing body = empty story).
    """
    arts = scan_article_json(spark, root, multi_line, glob)
    raw = F.coalesce(F.array_join(F.transform("body_text", lambda x: x["text"]), "\n"), F.lit(""))
    lines = story_lines(raw)
    return arts.select("document_name", "paper_id", story_part(lines).alias("story_lines"),
                       summary_part(lines).alias("summary_lines"))


def pandas_na_to_null(c: str):
    return F.when(F.col(c).isin(PANDAS_NA_VALUES), F.lit(None)).otherwise(F.col(c))


def scan_metadata_csv(spark: SparkSession, path: str, columns: list[str] = METADATA_COLUMNS,
                      mode: str = "FAILFAST") -> DataFrame:
    """Header CSV, only the named columns (pruned at the scan), all as text, pandas null rules.

    Malformed rows are an error unless ``mode`` says otherwise.

    Adds the file-order columns so that "first row" keeps its meaning downstream.
    """
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("mode", mode).csv(path))
    df = with_file_order(df.select(*columns))
    return df.select(*[pandas_na_to_null(c).alias(c) for c in columns], *FILE_ORDER)


def scan_pair_lines(spark: SparkSession, path: str) -> DataFrame:
    """One example per line (``\\n`` only): ``(unique_id, text_a, text_b)``, ids from 0 in file order."""
    lines = with_file_order(spark.read.option("lineSep", "\n").text(path))
    ided = sequence_ids(lines, FILE_ORDER, "unique_id")
    return ided.select("unique_id", split_pair_a(F.col("value")).alias("text_a"),
                       split_pair_b(F.col("value")).alias("text_b"))


def scan_story_files(spark: SparkSession, folder: str, partitioned: bool = False) -> DataFrame:
    """Regular files directly in ``folder`` whose name lacks ``summary``; whole file as text.

    Line ends ``\\r\\n`` and ``\\r`` become ``\\n`` (what Python's text mode does). With
    ``partitioned``, ``folder`` is a table of ``key=value`` sub-folders (the key becomes a
    column) and files one level down are read.
    """
    root = folder.rstrip("/")
    df = spark.read.text(folder, wholetext=True)
    parent = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    norm_root = F.regexp_replace(F.lit(root), "^file:(//(?=/))?", "")
    extra = [c for c in df.columns if c != "value"]  # partition columns, if any
    df = df.select(*extra, F.col("_metadata.file_name").alias("document_name"),
                   F.col("_metadata.file_path").alias("file_path"),
                   F.regexp_replace(F.col("value"), "\r\n?", "\n").alias("raw_story"),
                   parent.alias("_parent"))
    df = df.filter(~F.col("document_name").contains("summary"))
    if not partitioned:
        df = df.filter(F.regexp_replace("_parent", "^file:(//(?=/))?", "") == norm_root)
    return packed(df.drop("_parent"))


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary file: ``(token, id)``, the id being the 0-based line number."""
    lines = with_file_order(spark.read.option("lineSep", "\n").text(path))
    return sequence_ids(lines, FILE_ORDER, "id").select(py_strip(F.col("value")).alias("token"),
                                                         F.col("id").cast("int").alias("id"))


def sink_summaries_csv(summaries: DataFrame, path: str, order_col: str = "rank") -> None:
    """Write ``<index>, Paper id, Title, Summary`` with a header; index = 0-based rank.

    Quotes are doubled as pandas does. Rows are range-sorted so part files read back in
    name order give the ranking; no single task has to hold the table.
    """
    out = summaries.select(
        (F.col(order_col) - 1).cast("long").alias("index"),
        F.col("paper_id").alias("Paper id"), F.col("title").alias("Title"),
        F.col("summary").alias("Summary"))
    (out.orderBy("index").write.mode("errorifexists")
     .option("header", True).option("escape", '"').csv(path))


def read_summaries_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(F.col("index").cast("long").alias("index"), "Paper id", "Title", "Summary")


def articles_to_parquet(spark: SparkSession, root: str, out: str, multi_line: bool = True,
                        glob: str = "*.json") -> str:
    """Convert a corpus of small JSON files once into Parquet article records.

    One-article JSON files are not splittable and cost a file open each; the Parquet copy is
    columnar (the search reads two of its columns) and splits into even partitions.
    """
    from ..operators import articles as A
    arts = scan_article_json(spark, root, multi_line, glob)
    (arts.select("paper_id",
                 A.concat_text(F.col("abstract"), F.col("body_text")).alias("concat_text"),
                 F.col("metadata.title").alias("title"),
                 A.full_abstract(F.col("abstract")).alias("full_abstract"),
                 A.author_names(F.col("metadata.authors")).alias("authors"),
                 A.full_text(F.col("body_text")).alias("full_text"),
                 "file_path")
     .write.parquet(out))
    return out
