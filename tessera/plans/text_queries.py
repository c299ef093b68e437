"""Registered queries over the test tables: articles, stories, strings, metadata, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.arrays import word_trigrams as trigrams_of
from ..operators import articles as A
from ..operators import metadata as M
from ..operators import stories as ST
from ..operators.ids import sequence_ids as seq_ids
from ..session import read_table, scratch_path
from ..sources import derived as D
from ..sources import files as FS


def _size(c):
    return F.coalesce(F.size(c), F.lit(-1))


# --- articles ---------------------------------------------------------------------------

def _scanned_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = D.write_article_json(spark, sf_dir, scratch_path(spark, "articles"))
    # JSON Lines written by the text writer: several articles per ``.txt`` part file
    return FS.scan_article_json(spark, path, multi_line=False, glob="*.txt")


def scan_article_json(spark, sf_dir):
    a = _scanned_articles(spark, sf_dir)
    return a.select("paper_id", F.col("metadata.title").alias("title"), _size("abstract").alias("n_abstract"),
                    _size("body_text").alias("n_body"), _size("metadata.authors").alias("n_authors"))


def scan_article_files(spark, sf_dir):
    """One article per file, in sub-folders below the corpus folder."""
    path = scratch_path(spark, "article-files")
    FS.write_one_per_file(D.article_json_lines(spark, sf_dir), "value", f"{path}/corpus/part")
    a = FS.scan_article_json(spark, path, multi_line=True, glob="*.txt")
    return a.select("paper_id", F.col("metadata.title").alias("title"), _size("abstract").alias("n_abstract"),
                    _size("body_text").alias("n_body"), _size("metadata.authors").alias("n_authors"))


def scan_story_folder(spark, sf_dir):
    """One story per file, all directly in one folder."""
    path = scratch_path(spark, "story-files")
    FS.write_one_per_file(D.raw_stories(spark, sf_dir), "raw_story", path)
    s = ST.process_story(FS.scan_story_files(spark, path))
    return s.select(F.size("story_lines").alias("n_story"), F.size("summary_lines").alias("n_summary"),
                    F.md5(F.array_join("story_lines", "\n")).alias("story_md5"))


def scan_article_bodies(spark, sf_dir):
    path = D.write_article_json(spark, sf_dir, scratch_path(spark, "articles"))
    b = FS.scan_article_bodies(spark, path, multi_line=False, glob="*.txt")
    return b.select("paper_id", F.size("story_lines").alias("n_story_lines"),
                    F.size("summary_lines").alias("n_summary_lines"),
                    F.array_join("story_lines", "\n").alias("story"))


def article_text(spark, sf_dir):
    a = A.article_text(D.article_structs(spark, sf_dir))
    return a.select("paper_id", "full_abstract", "full_text", "concat_text")


def article_record(spark, sf_dir):
    return A.article_record(_scanned_articles(spark, sf_dir))


def author_names(spark, sf_dir):
    a = _scanned_articles(spark, sf_dir)
    return a.select("paper_id", A.author_names(F.col("metadata.authors")).alias("authors"))


def drop_empty_articles(spark, sf_dir):
    return A.drop_empty_articles(A.article_record(_scanned_articles(spark, sf_dir))).select("paper_id")


def lower_case(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", S.lower_case("text").alias("text_lower"))


def document_name(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", S.document_name("url").alias("document_name"))


# --- stories ------------------------------------------------------------------------------

def _stories(spark, sf_dir) -> DataFrame:
    return ST.process_story(D.raw_stories(spark, sf_dir))


def story_lines(spark, sf_dir):
    r = D.raw_stories(spark, sf_dir).select("conv_id", S.story_lines(F.col("raw_story")).alias("l"))
    return r.select("conv_id", F.size("l").alias("n_lines"), F.array_join("l", "\n").alias("lines"))


def add_missing_period(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    lines = F.filter(F.transform(S.raw_lines("text"), S.py_strip), lambda x: x != "")
    return c.select("conv_id", "turn", F.array_join(F.transform(lines, S.add_missing_period), "\n").alias("text"))


def split_story_summary(spark, sf_dir):
    s = _stories(spark, sf_dir)
    return s.select("conv_id", F.array_join("story_lines", "\n").alias("story"),
                    F.array_join("summary_lines", "\n").alias("summary"))


def join_summary(spark, sf_dir):
    s = ST.with_reference_summary(_stories(spark, sf_dir))
    return s.select("conv_id", "tgt_str")


def drop_empty_stories(spark, sf_dir):
    return ST.drop_empty_stories(_stories(spark, sf_dir)).select("conv_id")


def count_documents(spark, sf_dir):
    return ST.count_documents(ST.drop_empty_stories(_stories(spark, sf_dir)))


def scan_story_files(spark, sf_dir):
    path = D.write_story_files(spark, sf_dir, scratch_path(spark, "stories"))
    raw = FS.scan_story_files(spark, path, partitioned=True)
    s = ST.process_story(raw)
    return s.select(F.col("conv_id").cast("long").alias("conv_id"), F.size("story_lines").alias("n_story"),
                    F.size("summary_lines").alias("n_summary"))


# --- strings ------------------------------------------------------------------------------

def normalize_whitespace(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", S.normalize_whitespace("text").alias("text"))


def strip_text(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", S.py_strip("text").alias("text"))


def detokenize(spark, sf_dir):
    from ..operators.tokens import whitespace_tokens
    d = read_table(spark, sf_dir, "documents")
    pieces = D.word_pieces(whitespace_tokens(F.col("text")))
    return d.select("doc_id", S.detokenize(pieces).alias("text"))


def split_pair(spark, sf_dir):
    p = D.pair_lines(spark, sf_dir)
    return p.select("conv_id", "turn", S.split_pair_a(F.col("value")).alias("text_a"),
                    S.split_pair_b(F.col("value")).alias("text_b"))


def scan_pair_lines(spark, sf_dir):
    path = D.write_pair_lines(spark, sf_dir, scratch_path(spark, "pairs"))
    return FS.scan_pair_lines(spark, path)


def sequence_ids(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return seq_ids(c, ["conv_id", "turn"], "seq_id")


def word_trigrams(spark, sf_dir):
    from ..operators.tokens import whitespace_tokens
    d = read_table(spark, sf_dir, "documents")
    # per row: a document's trigrams never leave its task (no shuffle); a document is one row
    t = d.select("doc_id", trigrams_of(whitespace_tokens(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_trigrams"), F.size(F.array_distinct("t")).alias("n_distinct"))


# --- metadata -----------------------------------------------------------------------------

def _metadata(spark, sf_dir) -> DataFrame:
    path = D.write_metadata_csv(spark, sf_dir, scratch_path(spark, "metadata"))
    return FS.scan_metadata_csv(spark, path)


def scan_metadata_csv(spark, sf_dir):
    return _metadata(spark, sf_dir).select(*FS.METADATA_COLUMNS)


def dedup_keep_first(spark, sf_dir):
    return M.dedup_keep_first(_metadata(spark, sf_dir)).select(*FS.METADATA_COLUMNS)


def drop_null_rows(spark, sf_dir):
    return M.drop_null_rows(_metadata(spark, sf_dir)).select(*FS.METADATA_COLUMNS)


def metadata_clean(spark, sf_dir):
    return M.metadata_clean(_metadata(spark, sf_dir)).select(*FS.METADATA_COLUMNS)


def head_rows(spark, sf_dir):
    return M.head_rows(M.metadata_clean(_metadata(spark, sf_dir))).select(*FS.METADATA_COLUMNS)


# --- vocabulary ---------------------------------------------------------------------------

def load_vocabulary(spark, sf_dir):
    path = D.write_vocabulary(spark, sf_dir, scratch_path(spark, "vocab"))
    return FS.load_vocabulary(spark, path)


QUERIES = {
    "scan_article_json": scan_article_json,
    "scan_article_files": scan_article_files,
    "scan_story_folder": scan_story_folder,
    "scan_article_bodies": scan_article_bodies,
    "article_text": article_text,
    "article_record": article_record,
    "author_names": author_names,
    "drop_empty_articles": drop_empty_articles,
    "lower_case": lower_case,
    "document_name": document_name,
    "story_lines": story_lines,
    "add_missing_period": add_missing_period,
    "split_story_summary": split_story_summary,
    "join_summary": join_summary,
    "drop_empty_stories": drop_empty_stories,
    "count_documents": count_documents,
    "scan_story_files": scan_story_files,
    "normalize_whitespace": normalize_whitespace,
    "strip_text": strip_text,
    "detokenize": detokenize,
    "split_pair": split_pair,
    "scan_pair_lines": scan_pair_lines,
    "sequence_ids": sequence_ids,
    "word_trigrams": word_trigrams,
    "scan_metadata_csv": scan_metadata_csv,
    "dedup_keep_first": dedup_keep_first,
    "drop_null_rows": drop_null_rows,
    "metadata_clean": metadata_clean,
    "head_rows": head_rows,
    "load_vocabulary": load_vocabulary,
}
