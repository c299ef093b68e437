"""Inputs of the reference's shapes, derived by Spark from the given test tables.

Each builder reads whole tables; nothing is sampled or capped, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table
from .files import MANY_FILES

QUERY_TOKENS_PER_LABEL = 3  # FX5: the first three vectors of each label form its query


def vector_search_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Token vectors from ``embeddings``.

    Within each label, by ``vec_id``: the first three vectors are the query of that label
    ``(query_id, tok_no, token, vec)``; all other vectors belong to article ``vec_id div 10``
    ``(article_id, pos, token, vec)`` with ``pos`` the ``vec_id``.
    """
    emb = read_table(spark, sf_dir, "embeddings")
    # only (label, vec_id) rows reach the window, and a group limit keeps three of each
    # partition's labels before the shuffle; the others are what an anti-join leaves
    w = Window.partitionBy("label").orderBy("vec_id")
    firsts = (emb.select("label", "vec_id").withColumn("rn", F.row_number().over(w))
              .filter(F.col("rn") <= QUERY_TOKENS_PER_LABEL))
    queries = emb.join(firsts.select("vec_id", "rn"), "vec_id").select(
        F.col("label").cast("long").alias("query_id"), F.col("rn").cast("long").alias("tok_no"),
        F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vec"))
    article_tokens = emb.join(firsts.select("vec_id"), "vec_id", "left_anti").select(
        F.expr("vec_id div 10").alias("article_id"), F.col("vec_id").alias("pos"),
        F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vec"))
    return article_tokens, queries


def articles_from_long(article_tokens: DataFrame) -> DataFrame:
    """One row per article with its vectors in position order.

    A group holds one article's tokens, bounded by the encoder's token limit.
    """
    return (article_tokens.groupBy("article_id")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "token", "vec"))).alias("t"))
            .select("article_id", F.col("t.token").alias("tokens"), F.col("t.vec").alias("vecs")))


def text_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as articles ``(article_id, text)``."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` items as queries ``(query_id, text)``."""
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---------------------------------------------------------------------------------------
# Article JSON (FX1), metadata CSV (FX2), pair lines (FX3), stories (FX4), vocabulary (FX8)

# Special tokens written at the head of the derived vocabulary, ids 0..6
SPECIAL_TOKENS = ["[PAD]", "[unused0]", "[unused1]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]


def _lines(text):
    return F.split(text, "\n", -1)


def article_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as nested articles: first line = abstract, other lines = body entries.

    Shapes vary by ``doc_id`` to cover the reference's cases: every 5th article (id mod 5 =
    4) has no ``body_text``, every 7th (id mod 7 = 6) no ``abstract``; author ``middle`` is
    a list (id mod 3 = 0), an empty string (1) or an empty list (2).
    """
    d = read_table(spark, sf_dir, "documents")
    lines = _lines(F.col("text"))
    abstract = F.when(F.col("doc_id") % 7 == 6, F.lit(None)).otherwise(
        F.array(F.struct(F.element_at(lines, 1).alias("text"))))
    body = F.when(F.col("doc_id") % 5 == 4, F.lit(None)).otherwise(
        F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.struct(x.alias("text"))))
    middle = (F.when(F.col("doc_id") % 3 == 0, F.lit("@@LIST@@"))
              .when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.lit("@@EMPTY@@")))
    author = F.struct(F.col("lang").alias("first"), middle.alias("middle"), F.col("source").alias("last"))
    return d.select(
        F.col("doc_id"),
        F.col("doc_id").cast("string").alias("paper_id"),
        F.struct(F.col("source").alias("title"), F.array(author).alias("authors")).alias("metadata"),
        abstract.alias("abstract"), body.alias("body_text"))


def article_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per article, ``middle`` written as a string or as a list."""
    a = article_structs(spark, sf_dir)
    js = F.to_json(F.struct("paper_id", "metadata", "abstract", "body_text"))
    js = F.replace(js, F.lit('"@@LIST@@"'), F.to_json(F.array(F.col("metadata.authors")[0]["first"],
                                                                F.col("metadata.authors")[0]["last"])))
    js = F.replace(js, F.lit('"@@EMPTY@@"'), F.lit("[]"))
    return a.select("doc_id", js.alias("value"))


def write_article_json(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Articles as JSON Lines files (several articles per file; no reader needs an order)."""
    article_json_lines(spark, sf_dir).select("value").write.text(path)
    return path


def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata table from ``documents LEFT JOIN labels`` in doc_id order.

    abstract = first line, title = source, doi = doc_id (``NA`` when id mod 13 = 0),
    authors = lang (with a quoted line break when id mod 11 = 0), publish_time = quality.
    Extra columns ``row_uid`` and ``url`` are written but never read.
    """
    d = read_table(spark, sf_dir, "documents")
    lab = read_table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    authors = F.when(F.col("doc_id") % 11 == 0, F.concat(F.col("lang"), F.lit('\n"'), F.col("source"), F.lit('"'))
                     ).otherwise(F.col("lang"))
    doi = F.when(F.col("doc_id") % 13 == 0, F.lit("NA")).otherwise(F.col("doc_id").cast("string"))
    return j.select(
        F.col("doc_id"),
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("row_uid"),
        F.col("source").alias("title"),
        F.element_at(_lines(F.col("text")), 1).alias("abstract"),
        authors.alias("authors"), doi.alias("doi"),
        F.col("quality").cast("string").alias("publish_time"),
        F.lit("http://example.invalid/x").alias("url"))


def write_metadata_csv(spark: SparkSession, sf_dir: str, path: str) -> str:
    (metadata_rows(spark, sf_dir).orderBy("doc_id").drop("doc_id")
     .write.option("header", True).option("escape", '"').csv(path))
    return path


def pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_t ||| text_{t+1}`` for consecutive turns of a conversation (line breaks become
    spaces); the last turn stands alone."""
    c = read_table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    flat = F.regexp_replace(F.col("text"), "\n", " ")
    nxt = F.lead(flat).over(w)
    line = F.when(nxt.isNull(), flat).otherwise(F.concat(flat, F.lit(" ||| "), nxt))
    return c.select("conv_id", "turn", line.alias("value"))


def write_pair_lines(spark: SparkSession, sf_dir: str, path: str) -> str:
    pair_lines(spark, sf_dir).orderBy("conv_id", "turn").select("value").write.text(path)
    return path


def raw_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One story per conversation: turns in order joined by ``\\n``; assistant turns become
    ``@highlight`` followed by their text (the summary)."""
    c = read_table(spark, sf_dir, "conversations")
    part = F.when(F.col("role") == "assistant", F.concat(F.lit("@highlight\n"), F.col("text"))).otherwise(F.col("text"))
    return (c.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))).alias("t"))
            .select("conv_id", F.array_join(F.col("t.p"), "\n").alias("raw_story")))


def write_story_files(spark: SparkSession, sf_dir: str, path: str) -> str:
    """One story file per conversation, in folders ``conv_id=N``."""
    raw_stories(spark, sf_dir).repartition("conv_id").write.options(**MANY_FILES).partitionBy("conv_id").text(path)
    return path


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct whitespace words of ``documents`` (lower-cased)."""
    from ..functions.strings import words
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.explode(words(F.col("text"))).alias("token")).distinct()


def vocabulary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special tokens, then the distinct corpus words in sorted order: ``(ord, token)``."""
    specials = spark.createDataFrame([(i, t) for i, t in enumerate(SPECIAL_TOKENS)], "k int, token string")
    words_df = corpus_words(spark, sf_dir).select(F.lit(len(SPECIAL_TOKENS)).alias("k"), "token")
    return specials.unionByName(words_df)


def write_vocabulary(spark: SparkSession, sf_dir: str, path: str) -> str:
    vocabulary_lines(spark, sf_dir).orderBy("k", "token").select("token").write.text(path)
    return path


# Decoder begin and end tokens (BERT's first two unused slots)
BOS_TOKEN, EOS_TOKEN = "[unused0]", "[unused1]"
FLAT_VOCAB = 1000  # vocabulary size used to form flat candidate indexes


def word_pieces(ws):
    """Words longer than 6 characters become two pieces: first 4 characters, ``##`` + rest.

    Done on the space-joined words with one regular expression (code-generated string work,
    no per-word lambda); words never contain spaces.
    """
    joined = F.array_join(ws, " ")
    split = F.regexp_replace(joined, "(^| )([^ ]{4})([^ ]{3,})", "$1$2 ##$3")
    return F.array_remove(F.split(split, " ", -1), "")


def nbest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate table of one decoding step per document line (FX7).

    Every line of a document is a beam; its sequence is the begin token plus the line's word
    pieces. Each beam has two candidates: the end token (``cand`` 0) and the beam's first
    piece again (``cand`` 1). Log-probs are simple functions of ``n_chars`` and lengths.
    """
    from ..functions.strings import words
    d = read_table(spark, sf_dir, "documents")
    beams = d.select("doc_id", "n_chars", F.posexplode(_lines(F.col("text"))).alias("beam", "line"))
    pieces = word_pieces(words(F.col("line")))
    beams = beams.select("doc_id", "n_chars", "beam",
                         F.concat(F.array(F.lit(BOS_TOKEN)), pieces).alias("alive"))
    first = F.coalesce(F.try_element_at(F.col("alive"), F.lit(2)), F.lit(BOS_TOKEN))
    cands = beams.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("cand"), F.lit(EOS_TOKEN).alias("token")),
        F.struct(F.lit(1).alias("cand"), first.alias("token")))).alias("c"))
    token_id = F.when(F.col("c.cand") == 0, F.lit(2)).otherwise(F.lit(7) + F.length(F.col("c.token")) % 100)
    token_lp = F.when(F.col("c.cand") == 0, F.lit(-1.5)).otherwise(
        -(F.length(F.col("c.token")) % 5) / F.lit(2.0) - F.lit(0.25))
    return cands.select(
        "doc_id", (F.size("alive") - 1).alias("step"), F.col("beam").cast("int").alias("beam"),
        F.col("c.cand").alias("cand"), F.col("c.token").alias("token"), token_id.cast("int").alias("token_id"),
        "alive",
        (-((F.col("n_chars") + F.col("beam")) % 13) / F.lit(4.0)).alias("beam_logprob"),
        token_lp.cast("double").alias("token_logprob"),
        (F.col("beam") * FLAT_VOCAB + token_id).cast("long").alias("flat_index"))


def wordpiece_vocabulary(spark: SparkSession, sf_dir: str):
    """``Vocabulary``: special tokens, then the sorted distinct basic-tokenizer words of
    ``documents`` (a whole-word WordPiece vocabulary)."""
    from ..operators.tokens import Vocabulary, basic_tokenize
    d = read_table(spark, sf_dir, "documents").select("text")
    ws = basic_tokenize(d, "text", "w").select(F.explode("w").alias("token")).distinct()
    return Vocabulary.from_words(ws, SPECIAL_TOKENS)


def corpus_vocabulary(spark: SparkSession, sf_dir: str, source: str = "documents"):
    """``Vocabulary``: special tokens, then the sorted distinct whitespace words of ``source``
    (the same ids as the vocabulary file written by ``write_vocabulary``)."""
    from ..functions.strings import words
    from ..operators.tokens import Vocabulary
    t = read_table(spark, sf_dir, source)
    ws = t.select(F.explode(words(F.col("text"))).alias("token")).distinct()
    return Vocabulary.from_words(ws, SPECIAL_TOKENS)
