"""Tokens, vocabulary ids and padded model inputs.

Array-valued steps (padding, masks, segments, special tokens) are JVM expressions. The
vocabulary lookup on token arrays runs as a vectorised Arrow hash lookup per batch against
a broadcast vocabulary (no explode/regroup shuffle); on long tables it is a broadcast join.
A vocabulary beyond the broadcast bound is never broadcast: lookups then become shuffle
joins on the token (AQE splits a hot token's partition) and ids are numbered in parallel.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import (CLS, PAD, SEP, UNK, add_special_tokens, build_mask, real_mask, segment_ids,
                                truncate_or_pad, truncate_tokens, zeros)
from ..functions.strings import words
from .skew import join_with_hot_keys

MAX_VOCAB_ENTRIES = 1_000_000  # largest vocabulary that is broadcast to every worker
_WORKER_CACHE: dict = {}


def whitespace_tokens(text) -> Column:
    """Lower-cased whitespace words, empty pieces dropped (the whole-word tokenizer)."""
    return words(text)


class Vocabulary:
    """``(token, id)`` table; size checked before it is broadcast."""

    def __init__(self, table: DataFrame | None, max_entries: int = MAX_VOCAB_ENTRIES):
        self._table = None if table is None else table.select("token", F.col("id").cast("int").alias("id"))
        self.max_entries = max_entries
        self._bc = None
        self._size = None
        self._index = None
        self._known: dict = {}  # ids known without looking: the special tokens of ``from_words``

    @property
    def table(self) -> DataFrame:
        """``(token, id)`` as a DataFrame."""
        return self._table

    @classmethod
    def from_words(cls, words: DataFrame, specials: list[str], max_entries: int = MAX_VOCAB_ENTRIES) -> "Vocabulary":
        """Special tokens (ids 0..), then the distinct ``token`` values of ``words`` in sorted
        (byte) order, numbered by Spark at every size. Whether the result is broadcast is
        decided later, by its measured number of entries."""
        spark = words.sparkSession
        from .ids import sequence_ids
        head = spark.createDataFrame([(i, t) for i, t in enumerate(specials)], "k int, token string")
        body = words.select(F.lit(len(specials)).alias("k"), "token")
        vocab = cls(sequence_ids(head.unionByName(body), ["k", "token"], "id").select("token", "id"), max_entries)
        vocab._known = {t: i for i, t in enumerate(specials)}
        return vocab

    @property
    def size(self) -> int:
        if self._size is None:
            self._size = self.table.count()
        return self._size

    @property
    def fits_broadcast(self) -> bool:
        return self.size <= self.max_entries

    def broadcast(self, spark):
        if self._bc is None:
            if not self.fits_broadcast:
                raise ValueError(f"vocabulary of {self.size} entries exceeds the broadcast bound {self.max_entries}")
            tbl = self.table.toArrow().sort_by("id")
            # the key names this vocabulary in each worker's cache
            self._bc = spark.sparkContext.broadcast((uuid.uuid4().hex, tbl.column("token").to_pylist(),
                                                     tbl.column("id").to_pylist()))
        return self._bc

    def prepare(self, spark) -> None:
        """Broadcast when within the bound (cheap lookups); otherwise leave it distributed."""
        if self.fits_broadcast:
            self.broadcast(spark)

    def id_of(self, token: str) -> int:
        if token in self._known:
            return self._known[token]
        if self._bc is not None:  # the driver already holds the (bounded) vocabulary
            _, toks, ids = self._bc.value
            if self._index is None:
                self._index = dict(zip(toks, ids))
            if token not in self._index:
                raise KeyError(token)
            return int(self._index[token])
        row = self.table.filter(F.col("token") == token).agg(F.max("id").alias("id")).first()
        if row is None or row["id"] is None:
            raise KeyError(token)
        return int(row["id"])

    @property
    def token_table(self) -> DataFrame:
        """``(token, id)`` with one id per token: a token listed twice keeps its last line, as
        a dictionary built line by line would."""
        return self.table.groupBy("token").agg(F.max("id").alias("id"))


def _lookup_by_join(df: DataFrame, vocab_table: DataFrame, src_col: str, out_col: str, key: str, value: str,
                    default=None) -> DataFrame:
    """Array lookup through a shuffle join (vocabulary too large to broadcast).

    Explode with positions, join on the element (frequent elements, such as the id of the
    padding, meet their few entries where they are read and are kept out of the shuffle),
    regroup by row in position order, join the arrays back to their rows. The
    row-keyed input is written to the shared checkpoint folder first, so both branches
    see the same row keys even when work is redone.
    """
    from ..session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, "rows")
    df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    keyed = spark.read.parquet(path)
    long = keyed.select("_row", F.posexplode_outer(src_col).alias("_pos", key))
    got = join_with_hot_keys(long, vocab_table.select(key, value), key)
    val = F.col(value) if default is None else F.coalesce(F.col(value), F.lit(default))
    item = F.when(F.col("_pos").isNotNull(), F.struct("_pos", val.alias("v")))
    arrays = got.groupBy("_row").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return (keyed.join(arrays, "_row").withColumn(out_col, F.col("_items.v"))
            .drop("_row", "_items"))


def _vocab_index(bc):
    """Worker copy, built once per worker: token -> id (a token listed twice resolves to its
    last id) and id -> token."""
    name, toks, ids = bc.value
    key = ("vocab", name)
    if key not in _WORKER_CACHE:
        _WORKER_CACHE[key] = (dict(zip(toks, ids)), dict(zip(reversed(ids), reversed(toks))))
    return _WORKER_CACHE[key]


def _looked_up(values: pa.Array, index: dict, kind: pa.DataType, default=None) -> pa.Array:
    """Each value's entry in the index; only a batch's distinct values are looked up."""
    coded = pc.dictionary_encode(values)
    got = pa.array([index.get(v, default) for v in coded.dictionary.to_pylist()], kind)
    out = pc.take(got, coded.indices)
    return pc.fill_null(out, pa.scalar(default, kind)) if default is not None else out


def _rebuild_list(orig: pa.Array, values: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(orig), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values)


def tokens_to_ids(df: DataFrame, vocab: Vocabulary, tokens_col: str = "tokens", out_col: str = "input_ids",
                  unk_token: str = UNK) -> DataFrame:
    """Token arrays -> id arrays; unknown tokens get the id of ``unk_token``."""
    vocab.prepare(df.sparkSession)
    unk_id = vocab.id_of(unk_token)
    if not vocab.fits_broadcast:
        return _lookup_by_join(df, vocab.token_table, tokens_col, out_col, "token", "id", unk_id)
    bc = vocab.broadcast(df.sparkSession)
    keep = list(df.columns)
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def lookup(batches):
        index, _ = _vocab_index(bc)
        for rb in batches:
            col = rb.column(tokens_col)
            got = _looked_up(col.flatten(), index, pa.int32(), unk_id)
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + [_rebuild_list(col, got)],
                                             names=keep + [out_col])

    return df.mapInArrow(lookup, schema)


def ids_to_tokens(df: DataFrame, vocab: Vocabulary, ids_col: str = "ids", out_col: str = "tokens") -> DataFrame:
    """Id arrays -> token arrays (an unknown id gives null)."""
    vocab.prepare(df.sparkSession)
    if not vocab.fits_broadcast:
        return _lookup_by_join(df, vocab.table, ids_col, out_col, "id", "token")
    bc = vocab.broadcast(df.sparkSession)
    keep = list(df.columns)
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.StringType()))])

    def lookup(batches):
        _, back = _vocab_index(bc)
        for rb in batches:
            col = rb.column(ids_col)
            toks = _looked_up(pc.cast(col.flatten(), pa.int32()), back, pa.string())
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + [_rebuild_list(col, toks)],
                                             names=keep + [out_col])

    return df.mapInArrow(lookup, schema)


def token_ids_long(long: DataFrame, vocab: Vocabulary, unk_token: str = UNK) -> DataFrame:
    """Long table ``(..., token)`` -> adds ``id`` by a left join to the vocabulary: broadcast
    when within the bound, else a shuffle join from which the frequent tokens are kept out."""
    unk_id = vocab.id_of(unk_token)
    return (_vocabulary_join(long, vocab.token_table, "token", vocab.fits_broadcast)
            .withColumn("id", F.coalesce(F.col("id"), F.lit(unk_id)).cast("int")))


def id_tokens_long(long: DataFrame, vocab: Vocabulary, id_col: str = "id") -> DataFrame:
    """Long table ``(..., id)`` -> adds ``token`` by a left join to the vocabulary, joined as
    in ``token_ids_long``."""
    return _vocabulary_join(long, vocab.table.withColumnRenamed("id", id_col), id_col, vocab.fits_broadcast)


def _vocabulary_join(long: DataFrame, table: DataFrame, key: str, fits: bool) -> DataFrame:
    columns = [*long.columns, *[c for c in table.columns if c != key]]
    out = long.join(F.broadcast(table), key, "left") if fits else join_with_hot_keys(long, table, key)
    return out.select(*columns)


# --- model input rows -----------------------------------------------------------------

def bert_tokens(tokens, seq_length: int = 128) -> Column:
    """``[CLS]`` + first ``seq_length - 2`` tokens + ``[SEP]``."""
    return add_special_tokens(truncate_tokens(tokens, seq_length))


def model_input_rows(df: DataFrame, vocab: Vocabulary, tokens_col: str = "tokens",
                     seq_length: int = 128) -> DataFrame:
    """``tokens`` (with specials), ``input_ids``/``input_mask``/``input_type_ids`` padded with 0
    to exactly ``seq_length``; the column of whole texts' tokens is not returned."""
    # the whole word array stays behind: only the kept tokens travel to the lookup
    pre = df.withColumn("tokens", bert_tokens(F.col(tokens_col), seq_length)).drop(
        *[c for c in (tokens_col,) if c != "tokens"])
    ided = tokens_to_ids(pre, vocab, "tokens", "_ids")
    pad_id = 0
    return (ided.withColumn("input_ids", truncate_or_pad(F.col("_ids"), seq_length, pad_id))
            .withColumn("input_mask", real_mask(F.col("_ids"), seq_length))
            .withColumn("input_type_ids", zeros(seq_length))
            .drop("_ids"))


def encode_lines(lines) -> Column:
    """Each line as ``[CLS] tokens [SEP]`` (whole-word tokens), concatenated."""
    return F.flatten(F.transform(lines if isinstance(lines, Column) else F.col(lines),
                                 lambda l: add_special_tokens(whitespace_tokens(l))))


def collate_rows(stories: DataFrame, vocab: Vocabulary, block_size: int = 512, key_col: str = "document_name"
                 ) -> DataFrame:
    """One encoded row per non-empty story: ``src``, ``segs``, ``mask_src``, ``tgt_str``.

    ``src`` = story lines encoded and cut or padded to ``block_size``; ``segs`` alternate at
    every ``[CLS]``; ``mask_src`` is 0 on padding.
    """
    vocab.prepare(stories.sparkSession)
    pad_id, cls_id = vocab.id_of(PAD), vocab.id_of(CLS)
    # a story without lines has no tokens: filtered on the encoded column, so that the line
    # rules are not repeated in a pushed-down condition
    pre = (stories.select(key_col, encode_lines(F.col("story_lines")).alias("_tok"),
                          F.array_join("summary_lines", " ").alias("tgt_str"))
           .filter(F.size("_tok") > 0))
    # cut first: ids past the block are never looked up
    pre = pre.withColumn("_tok", F.slice("_tok", 1, block_size))
    ided = tokens_to_ids(pre, vocab, "_tok", "_ids")
    src = truncate_or_pad(F.col("_ids"), block_size, pad_id)
    return (ided.select(key_col, src.alias("src"), "tgt_str")
            .withColumn("segs", segment_ids(F.col("src"), cls_id))
            .withColumn("mask_src", build_mask(F.col("src"), pad_id))
            .select(key_col, "src", "segs", "mask_src", "tgt_str"))


# --- WordPiece ------------------------------------------------------------------------

def _wordpiece_tokenizer(bc):
    name, toks, ids = bc.value
    key = ("wordpiece", name)
    if key not in _WORKER_CACHE:
        from tokenizers import Tokenizer, models, normalizers, pre_tokenizers
        tok = Tokenizer(models.WordPiece(vocab=dict(zip(toks, ids)), unk_token=UNK, max_input_chars_per_word=100))
        tok.normalizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True,
                                                    strip_accents=None, lowercase=True)
        tok.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
        _WORKER_CACHE[key] = tok
    return _WORKER_CACHE[key]


def wordpiece_tokenize(df: DataFrame, vocab: Vocabulary, text_col: str = "text", out_col: str = "pieces"
                       ) -> DataFrame:
    """Lower-case, split on whitespace and punctuation, greedy longest match against the
    vocabulary (``##`` continuations), unknown word -> ``[UNK]``. One tokenizer per Python
    worker; texts are encoded in Arrow batches. A vocabulary beyond the broadcast bound is
    joined to the texts' distinct words and their parts."""
    if not vocab.fits_broadcast:
        return _wordpiece_by_join(df, vocab, text_col, out_col)
    bc = vocab.broadcast(df.sparkSession)
    keep = list(df.columns)
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.StringType()))])

    def run(batches):
        tok = _wordpiece_tokenizer(bc)
        for rb in batches:
            texts = [t if t is not None else "" for t in rb.column(text_col).to_pylist()]
            enc = tok.encode_batch(texts, add_special_tokens=False)
            pieces = pa.array([e.tokens for e in enc], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + [pieces], names=keep + [out_col])

    return df.mapInArrow(run, schema)


MAX_WORD_CHARS = 100  # a longer word is unknown (the library's rule)


def _parts(batches):
    """``(word, token)`` for every part of a word that may be looked up: its beginnings, and ``##`` + others."""
    for rb in batches:
        for word in rb.column(0).to_pylist():
            n = len(word)
            parts = [word[i:j] if i == 0 else "##" + word[i:j] for i in range(n) for j in range(i + 1, n + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([word] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["word", "token"])


def _cut_words(batches):
    """Pieces of words by the library, whose vocabulary is what was found of a batch's words' parts."""
    from tokenizers import models
    for rb in batches:
        known = dict.fromkeys([UNK, *pc.unique(rb.column(1).flatten()).to_pylist()])
        model = models.WordPiece(vocab={t: i for i, t in enumerate(known)}, unk_token=UNK, max_input_chars_per_word=MAX_WORD_CHARS)
        pieces = [[t.value for t in model.tokenize(word)] for word in rb.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(pieces, pa.list_(pa.string()))], names=["word", "pieces"])


def _wordpiece_by_join(df: DataFrame, vocab: Vocabulary, text_col: str, out_col: str) -> DataFrame:
    """WordPiece without a broadcast vocabulary: a distinct word that is an entry is its own piece; the
    parts of the others are joined to the vocabulary, and the library cuts each word with those found."""
    from ..session import scratch_path
    spark, columns = df.sparkSession, list(df.columns)
    path = scratch_path(spark, "rows")
    basic_tokenize(df.withColumn("_row", F.monotonically_increasing_id()), text_col, "_words").write.parquet(path)
    keyed = spark.read.parquet(path)
    long = keyed.select("_row", F.posexplode("_words").alias("_pos", "word"))
    entries = vocab.token_table.select("token")
    words_ = long.select("word").distinct()
    short = words_.filter(F.length("word") <= MAX_WORD_CHARS)
    whole = short.join(entries, F.col("word") == F.col("token"), "left_semi").select("word", F.array("word").alias("pieces"))
    other = short.join(entries, F.col("word") == F.col("token"), "left_anti")
    found = (other.mapInArrow(_parts, "word string, token string").join(entries, "token", "left_semi")
             .groupBy("word").agg(F.collect_set("token").alias("tokens")))  # one word's parts, a bounded number
    cut = found.mapInArrow(_cut_words, "word string, pieces array<string>")
    pieces = long.join(whole.unionByName(cut), "word", "left").select(
        "_row", "_pos", F.coalesce("pieces", F.array(F.lit(UNK))).alias("pieces"))  # no part found, or too long
    rows = pieces.groupBy("_row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "pieces"))),
                                                            lambda p: p["pieces"])).alias("_pieces"))
    return keyed.join(rows, "_row", "left").select(*columns, F.coalesce("_pieces", F.array().cast("array<string>")).alias(out_col))


def special_ids(vocab: Vocabulary) -> dict:
    return {t: vocab.id_of(t) for t in (PAD, UNK, CLS, SEP)}


def _basic_tokenizer():
    key = ("basic",)
    if key not in _WORKER_CACHE:
        from tokenizers import normalizers, pre_tokenizers
        _WORKER_CACHE[key] = (normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True,
                                                         strip_accents=None, lowercase=True),
                              pre_tokenizers.BertPreTokenizer())
    return _WORKER_CACHE[key]


def basic_tokenize(df: DataFrame, text_col: str = "text", out_col: str = "words") -> DataFrame:
    """BERT's basic tokenizer (clean, lower-case, strip accents, split on whitespace and
    punctuation) in Arrow batches: the words WordPiece then matches against a vocabulary."""
    keep = list(df.columns)
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.StringType()))])

    def run(batches):
        norm, pre = _basic_tokenizer()
        for rb in batches:
            out = [[w for w, _ in pre.pre_tokenize_str(norm.normalize_str(t))] if t is not None else []
                   for t in rb.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + [pa.array(out, pa.list_(pa.string()))],
                                             names=keep + [out_col])

    return df.mapInArrow(run, schema)


def segment_ids_long(long: DataFrame, key_col: str, pos_col: str, id_col: str, separator) -> DataFrame:
    """``segment_ids`` on a long table ``(key, pos, id)``: running count of separators up to
    each position, minus one, modulo 2 (``pmod``: -1 -> 1).

    A segmented prefix sum in two passes, so that a sequence may be longer than a task: rows are
    range-sorted by (key, pos), each task counts along its own rows and the counts are written
    (which cuts the lineage, so both passes see the same cuts); then what earlier tasks
    counted of a sequence that a cut runs through is added. Only the sequences at the cuts
    need that: at most two rows per task, which bounds the broadcast.
    """
    from pyspark.sql import Window

    from ..session import scratch_path
    spark = long.sparkSession
    columns = long.columns
    schema = T.StructType([*long.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_count", T.LongType())])
    ordered = long.repartitionByRange(key_col, pos_col).sortWithinPartitions(key_col, pos_col)

    def count(batches):
        from pyspark import TaskContext
        task, key, carried, begun = TaskContext.get().partitionId(), None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, found = batch.column(key_col), pc.fill_null(pc.equal(batch.column(id_col), separator), False)
            hits = np.cumsum(found.to_numpy(zero_copy_only=False).astype(np.int64))
            coded = pc.fill_null(pc.dictionary_encode(keys).indices, -1).to_numpy()
            first = np.append(0, np.flatnonzero(np.diff(coded)) + 1)  # where each sequence begins
            before = np.append(0, hits)[first]
            if begun and keys[0].as_py() == key:
                before[0] -= carried  # goes on from the batch before
            counts = hits - np.repeat(before, np.diff(np.append(first, batch.num_rows)))
            key, carried, begun = keys[batch.num_rows - 1].as_py(), int(counts[-1]), True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, task, np.int32)), pa.array(counts)],
                                             names=[*columns, "_task", "_count"])

    path = scratch_path(spark, "segments")
    ordered.mapInArrow(count, schema).write.parquet(path)
    counted = spark.read.schema(schema).parquet(path)
    totals = counted.groupBy(key_col, "_task").agg(F.max("_count").alias("_n"))
    cut = totals.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(key_col))).filter("_parts > 1")
    earlier = Window.partitionBy(key_col).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.select(F.col(key_col).alias("_key"), F.col("_task").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    out = counted.join(F.broadcast(offsets), counted[key_col].eqNullSafe(offsets["_key"]) & (counted["_task"] == offsets["_at"]), "left")
    seg = F.pmod(F.col("_count") + F.coalesce("_off", F.lit(0)) - 1, F.lit(2)).cast("int")
    return out.select(*columns, seg.alias("seg"))
