"""Batch inference: one vector per token, on the executors, in Arrow batches.

An *encoder* turns token lists into vectors. Two are provided:

* ``LookupEncoder`` - a token-vector table standing in for a model (the test encoder):
  token -> row ``conv(substr(md5(token),1,8),16,10) mod n`` of the table. The id step is
  a JVM expression; the row gather runs in numpy per Arrow batch.
* ``BatchEncoder`` - a user's model: ``make_predict_fn()`` is called once per Python
  worker and returns ``fn(input_ids[B,L], input_mask[B,L]) -> vectors[B,L,D]``; rows are fed
  in micro-batches of ``batch_size`` (the last short batch is kept).

A model's weights, and a lookup table within its measured bound, travel once per executor
and the article side is not shuffled. A larger lookup table stays distributed: each document's
distinct token ids are joined to it (``token_vectors``), so its size has no limit.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import CLS, SEP
from ..functions.strings import words
from ..functions.vectors import MICRO, round_vector

VECS_TYPE = T.ArrayType(T.ArrayType(T.FloatType()))
MAX_MODEL_BYTES = 256 << 20  # a larger lookup table is joined instead of broadcast

_WORKER_MODELS: dict = {}  # one model per Python worker process, by the encoder's own id


def worker_model(key: str, make):
    """``make()`` once per Python worker and key. Kept at module level: a task finds it by
    import, whereas a dictionary named inside a shipped function would travel with each task."""
    if key not in _WORKER_MODELS:
        _WORKER_MODELS[key] = make()
    return _WORKER_MODELS[key]


OUTPUT_BATCH_BYTES = 16 * 1024 * 1024  # cap of one Arrow batch of vectors sent back to the JVM
IN_TASK_BYTES = 1 << 20  # of vectors that the next step takes over in the same task: they stay in the processor's cache


def row_slices(rb: pa.RecordBatch, bytes_per_row: float, cap: int = OUTPUT_BATCH_BYTES):
    """Slices of ``rb`` whose output stays under ``cap`` bytes (at least one row each)."""
    step = max(1, int(cap // max(1.0, bytes_per_row)))
    for s in range(0, rb.num_rows, step):
        yield rb.slice(s, step)


def _nested_vectors(V: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """(T x D) matrix + per-row token counts -> list<list<float>>."""
    T_, D = V.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, T_ * D + 1, D, dtype=np.int32)),
                                     pa.array(V.reshape(-1).astype(np.float32)))
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), inner)


def lookup_token_ids(tokens: Column, n_rows: int) -> Column:
    """Row of the lookup table for each token: first 8 hex digits of md5, modulo rows."""
    return F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"),
                                                F.lit(n_rows)))


def hashed_rows(tokens: pa.Array, n_rows: int) -> np.ndarray:
    """``lookup_token_ids`` of an Arrow array of tokens; each of its distinct tokens is hashed once."""
    coded = pc.dictionary_encode(tokens)
    digests = b"".join([hashlib.md5(t).digest() for t in coded.dictionary.cast(pa.large_binary()).to_pylist()])
    return (np.frombuffer(digests, ">u4")[::4].astype(np.int64) % n_rows)[coded.indices.to_numpy(zero_copy_only=False)]


class LookupEncoder:
    """Token-vector table used as the encoder (row order = ``order_col``)."""

    def __init__(self, table: DataFrame, vec_col: str = "embedding", order_col: str = "vec_id",
                 max_bytes: int = MAX_MODEL_BYTES):
        self.table = table
        self.vec_col = vec_col
        self.order_col = order_col
        self.max_bytes = max_bytes
        self._n = None
        self._bc = None
        self._rows = None

    @property
    def n_rows(self) -> int:
        if self._n is None:
            stats = self.table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(self.vec_col)).alias("d")).first()
            self._n, self._dim = int(stats["n"]), int(stats["d"] or 0)
        return self._n

    @property
    def fits(self) -> bool:
        """Whether the table is within the broadcast bound (measured: rows x width)."""
        return self.n_rows * self._dim * 4 <= self.max_bytes

    def rows(self) -> DataFrame:
        """``(tok_id, vec)``: the table under its row numbers, numbered by Spark."""
        if self._rows is None:
            from .ids import sequence_ids
            self._rows = (sequence_ids(self.table.select(self.order_col, self.vec_col), [self.order_col], "tok_id")
                          .select("tok_id", F.col(self.vec_col).alias("vec")))
        return self._rows

    def token_ids(self, tokens: Column) -> Column:
        return lookup_token_ids(tokens, self.n_rows)

    def gather_fn(self):
        """Worker-side function: flat token ids -> (tokens x dim) float32 vectors."""
        bc = self._bc
        if bc is None:
            raise RuntimeError("call broadcast(spark) first")

        def gather(flat, bc=bc):
            return bc.value[flat]
        return gather

    def broadcast(self, spark):
        if self._bc is None:
            if not self.fits:  # callers take the join then
                raise RuntimeError("the lookup table is beyond the broadcast bound")
            tbl = self.table.select(self.order_col, self.vec_col).toArrow().sort_by(self.order_col)
            vec = tbl.column(self.vec_col).combine_chunks()
            W = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(vec), -1)
            self._bc = spark.sparkContext.broadcast(W)
        return self._bc


def _kept(df: DataFrame, keep: list | None, out_col: str, extra: list) -> tuple:
    """``df`` with the columns that the step needs, those it returns, and its schema."""
    if keep is None:
        return df, list(df.columns), T.StructType(df.schema.fields + [T.StructField(out_col, VECS_TYPE)])
    return df.select(*keep, *extra), keep, T.StructType([*[df.schema[c] for c in keep], T.StructField(out_col, VECS_TYPE)])


class InTask:
    """Rows that a task makes of a DataFrame's Arrow batches. A later step takes them over as they are
    (``then``) in the same task, so that vectors do not go through the JVM from step to step."""

    def __init__(self, df: DataFrame, make, schema):
        self.df, self.make, self.schema = df, make, schema

    def then(self, fold, schema) -> "InTask":
        make = self.make
        return InTask(self.df, lambda batches: fold(make(batches)), schema)

    def rows(self) -> DataFrame:
        return self.df.mapInArrow(self.make, self.schema)


def _in_task(df: DataFrame, make_vectors, schema: T.StructType, fold) -> DataFrame:
    """Rows with vectors; with ``fold = (function of batches, schema)`` what it makes of them in the same
    task: vectors that are only folded do not go through the JVM to a second Python worker."""
    made = InTask(df, make_vectors, schema)
    return (made if fold is None else made.then(*fold)).rows()


def embed_tokens(df: DataFrame, encoder: LookupEncoder, tokens_col: str = "tokens", out_col: str = "vecs",
                 fold: tuple | None = None, keep: list | None = None, in_task: bool = False) -> DataFrame | InTask:
    """Add ``out_col`` = one float vector per token of ``tokens_col`` (lookup encoder).

    ``keep``: the columns to return beside it (all). ``fold``: see ``_in_task``; needs a table within the bound,
    as does ``in_task``, which returns the rows as ``InTask``."""
    if not encoder.fits:
        if fold is not None or in_task:
            raise ValueError("vectors of a joined table are folded by a step of their own")
        return _embed_by_join(df, encoder, tokens_col, out_col)
    spark = df.sparkSession
    bc, n_rows = encoder.broadcast(spark), encoder.n_rows
    cap = IN_TASK_BYTES if in_task or fold is not None else OUTPUT_BATCH_BYTES
    keep = list(df.columns) if keep is None else keep
    tmp, keep, out_schema = _kept(df, keep, out_col, [c for c in [tokens_col] if c not in keep])

    def gather(batches, bc=bc, keep=keep):
        W = bc.value
        for big in batches:
            tokens = big.column(tokens_col)
            rows, at = hashed_rows(tokens.flatten(), n_rows), 0
            for rb in row_slices(big, len(rows) * W.shape[1] * 4 / max(1, big.num_rows), cap):
                lengths = pc.fill_null(pc.list_value_length(rb.column(tokens_col)), 0).to_numpy(zero_copy_only=False)
                some = rows[at:at + int(lengths.sum())]
                at += len(some)
                yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), _nested_vectors(W[some], lengths)], names=keep + [out_col])

    return InTask(tmp, gather, out_schema) if in_task else _in_task(tmp, gather, out_schema, fold)


def token_vectors(df: DataFrame, encoder: LookupEncoder, key_col: str, ids_col: str = "tok_ids") -> DataFrame:
    """``(key, vec)`` for each distinct token id of each row, by a join on the id.

    A frequent id is one row per document on this side only; adaptive execution splits its
    partition, the table side has one row per id.
    """
    long = df.select(key_col, F.explode(F.array_distinct(ids_col)).alias("tok_id"))
    return long.join(encoder.rows(), "tok_id").select(key_col, "vec")


def _embed_by_join(df: DataFrame, encoder: LookupEncoder, tokens_col: str, out_col: str) -> DataFrame:
    """Vectors of every token through the join on its id."""
    keyed = df.withColumn("_tok_ids", encoder.token_ids(F.col(tokens_col)))
    return vectors_of_ids(keyed, encoder, "_tok_ids", out_col).drop("_tok_ids")


def vectors_of_ids(df: DataFrame, encoder: LookupEncoder, ids_col: str, out_col: str) -> DataFrame:
    """``df`` with the vector of every id through a join, put back in order per row (a group is
    one row's ids). Needs no broadcast; frequent ids are left to adaptive execution."""
    from ..session import scratch_path
    path = scratch_path(df.sparkSession, "rows")
    df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    keyed = df.sparkSession.read.parquet(path)
    long = keyed.select("_row", F.posexplode(ids_col).alias("_pos", "tok_id"))
    got = (long.join(encoder.rows(), "tok_id").groupBy("_row")
           .agg(F.sort_array(F.collect_list(F.struct("_pos", "vec"))).alias("_v")))
    return (keyed.join(got, "_row", "left").withColumn(out_col, F.coalesce(F.col("_v.vec"), F.array().cast(VECS_TYPE)))
            .drop("_row", "_v"))


class BatchEncoder:
    """A user's encoder model run in micro-batches on padded model input rows.

    ``make_predict_fn`` must be picklable; it is called once per Python worker and encoder
    object (``name`` is only a label). The returned function maps ``input_ids``/``input_mask``
    int32 matrices ``[B, L]`` - and ``input_type_ids`` if ``with_types`` - to float vectors
    ``[B, L, D]``.
    """

    def __init__(self, make_predict_fn, name: str = "model", batch_size: int = 32, with_types: bool = False):
        self.make_predict_fn = make_predict_fn
        self.name = name
        self.batch_size = batch_size
        self.with_types = with_types
        self.key = f"{name}-{uuid.uuid4().hex}"


def embed_model_inputs(df: DataFrame, encoder: BatchEncoder, ids_col: str = "input_ids",
                       mask_col: str = "input_mask", out_col: str = "vecs",
                       type_col: str = "input_type_ids", fold: tuple | None = None, keep: list | None = None) -> DataFrame:
    """Vectors of the real (mask = 1) positions of fixed-length model input rows.
    ``fold`` and ``keep`` as in ``embed_tokens``."""
    make, key, bs = encoder.make_predict_fn, encoder.key, encoder.batch_size
    inputs = [ids_col, mask_col] + ([type_col] if encoder.with_types else [])
    df, keep, out_schema = _kept(df, keep, out_col, inputs)

    def infer(batches):
        fn = worker_model(key, make)
        for big in batches:
            if big.num_rows == 0:
                continue
            L = int(pc.max(pc.list_value_length(big.column(ids_col))).as_py())
            # output bytes per row are unknown before the model runs: budget 1024 floats a token
            for rb in row_slices(big, L * 1024 * 4):
                yield _infer_batch(rb, fn, bs, L, inputs, keep, out_col)

    return _in_task(df, infer, out_schema, fold)


def _infer_batch(rb, fn, bs, L, inputs, keep, out_col) -> pa.RecordBatch:
    """Run the model on micro-batches of ``bs`` rows; keep the vectors of real positions."""
    n = rb.num_rows
    mats = [rb.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, L) for c in inputs]
    parts = [np.asarray(fn(*(m[s:s + bs] for m in mats)), dtype=np.float32) for s in range(0, n, bs)]
    out = np.concatenate(parts, axis=0)  # [n, L, D]
    real = mats[1].astype(bool)
    vecs = _nested_vectors(out[real], real.sum(axis=1))  # row-major: row 0's tokens, then row 1's
    return pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + [vecs], names=keep + [out_col])


def word_windows(text: Column, seq_length: int = 128) -> Column:
    """The whole text as consecutive windows of at most ``seq_length - 2`` words, each one
    string of words joined by spaces (a text without words is one empty window).

    One regular expression marks the cuts in the joined words; no lambda slices the array.
    """
    n = seq_length - 2
    joined = F.array_join(words(text), " ")
    return F.split(F.regexp_replace(joined, "\\G((?:[^ ]++ ){%d}[^ ]++) " % (n - 1), "$1\n"), "\n", -1)


def word_tokens(text: Column, seq_length: int = 128) -> Column:
    """Lookup-encoder tokens of a whole text: every window of ``seq_length - 2`` words between
    its own ``[CLS]`` and ``[SEP]``. ``seq_length`` is the model's window, never a limit."""
    framed = F.array_join(word_windows(text, seq_length), f" {SEP} {CLS} ")
    return F.array_remove(F.split(F.concat(F.lit(f"{CLS} "), framed, F.lit(f" {SEP}")), " ", -1), "")


def distinct_word_tokens(text: Column) -> Column:
    """The distinct tokens of ``word_tokens``, without order. Enough where a token-wise encoder
    feeds a minimum over tokens: repeated tokens and the windows' order change nothing."""
    return F.array_distinct(F.concat(F.array(F.lit(CLS), F.lit(SEP)), words(text)))


def first_vector_per_token(df: DataFrame, key_col: str = "query_id", tokens_col: str = "tokens",
                           vecs_col: str = "vecs") -> DataFrame:
    """One row per distinct token, first occurrence, in order of first appearance.

    ``(key, tok_no, token, vec)``, ``[CLS]``/``[SEP]`` included. Works per row, no shuffle, and
    takes time in proportion to the row's tokens.
    """
    @F.pandas_udf("array<int>")
    def first_places(tokens: pd.Series) -> pd.Series:
        # from the last token to the first, so that the first place of each is the one that stays
        return tokens.map(lambda t: None if t is None else list(dict(zip(reversed(t), range(len(t) - 1, -1, -1))).values()))

    found = df.select(key_col, tokens_col, vecs_col, F.array_sort(first_places(F.col(tokens_col))).alias("_places"))
    return (found.select(key_col, tokens_col, vecs_col, F.posexplode("_places").alias("tok_no", "_place"))
            .select(key_col, F.col("tok_no").cast("long"), F.get(tokens_col, "_place").alias("token"),
                    F.get(vecs_col, "_place").alias("vec")))


def token_vectors_long(df: DataFrame | InTask, key_col: str = "article_id", tokens_col: str = "tokens",
                       vecs_col: str = "vecs") -> DataFrame | InTask:
    """Long table ``(key, pos, token, vec)`` (vectors rounded to 6 places as doubles)."""
    if isinstance(df, InTask):
        schema = T.StructType([df.schema[key_col], T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()),
                               T.StructField("vec", T.ArrayType(T.DoubleType()))])
        return df.then(lambda batches: _exploded(batches, [key_col, tokens_col, vecs_col], schema.names), schema)
    return (df.select(key_col, F.posexplode(F.arrays_zip(F.col(tokens_col).alias("token"),
                                                         F.col(vecs_col).alias("vec"))).alias("pos", "z"))
            .select(key_col, "pos", F.col("z.token").alias("token"), round_vector("z.vec").alias("vec")))


def _rounded(values: np.ndarray) -> np.ndarray:
    """Single precision numbers rounded to 6 places, halves away from zero, as doubles: their products
    with a million are exact."""
    out = values.astype(np.float64)
    out *= MICRO
    whole = np.abs(out)
    whole += 0.5
    np.floor(whole, out=whole)
    np.copysign(whole, out, out=out)
    out /= MICRO
    return out


def _exploded(batches, columns: list, names: list):
    """Batches of (key, tokens, vectors) as one row per token, with its position and rounded vector."""
    for rb in batches:
        key, tokens, vecs = (rb.column(c) for c in columns)
        counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = int(counts.sum())
        if not n:
            continue
        row = np.repeat(np.arange(len(counts)), counts)
        pos = np.arange(n) - (np.cumsum(counts) - counts)[row]
        flat = _rounded(vecs.flatten().flatten().to_numpy(zero_copy_only=False))
        vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(flat) // n, dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([key.take(pa.array(row)), pa.array(pos.astype(np.int32)), tokens.flatten(), vec], names=names)


def gathered(df: DataFrame, key_col: str) -> DataFrame:
    """``df`` with the rows of a key next to each other in one task, which later row-wise steps keep."""
    return df.repartition(key_col).sortWithinPartitions(key_col)


def _key_runs(batches, schema: pa.Schema, rows: int = 4096):
    """Batches of a gathered table as tables of whole keys with the number of each row's key."""
    held, n = [], 0

    def numbered(table):
        codes = pc.fill_null(pc.dictionary_encode(table.column(0).combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
        return np.append(0, np.cumsum(codes[1:] != codes[:-1]))

    for rb in batches:
        if not rb.num_rows:
            continue
        held.append(rb)
        n += rb.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held, schema).combine_chunks()
        runs = numbered(table)
        cut = int(np.searchsorted(runs, runs[-1]))  # the last key may go on
        if cut:
            yield table.slice(0, cut).combine_chunks(), runs[:cut]
        held, n = table.slice(cut).combine_chunks().to_batches(), 0
    if held:
        table = pa.Table.from_batches(held, schema).combine_chunks()
        yield table, numbered(table)


def _sorted_by_vector(table: pa.Table, runs: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``order`` with rows of one key, token and position (a key's rows repeat) ordered by their vectors."""
    pos, token = (table.column(c).combine_chunks().take(order) for c in ("pos", "token"))
    same = (runs[order][1:] == runs[order][:-1]) & pc.fill_null(pc.equal(pos[1:], pos[:-1]), False).to_numpy(zero_copy_only=False)
    same &= pc.fill_null(pc.equal(token[1:], token[:-1]), False).to_numpy(zero_copy_only=False)
    out, firsts = order.copy(), np.flatnonzero(np.append(True, ~same))
    ends = np.append(firsts[1:], len(order))
    several = np.flatnonzero(ends - firsts > 1)
    for a, b in zip(firsts[several], ends[several]):
        vecs = table.column("vec").take(order[a:b]).to_pylist()
        out[a:b] = order[a:b][sorted(range(b - a), key=lambda i: vecs[i])]
    return out


def _taken(vecs: pa.Array, order: np.ndarray) -> pa.Array:
    """``vecs.take(order)``; vectors of one length are rows of a matrix."""
    flat = vecs.flatten()
    dim = len(flat) // max(1, len(vecs))
    if not dim or vecs.null_count or flat.null_count or not pc.all(pc.equal(pc.list_value_length(vecs), dim)).as_py():
        return vecs.take(pa.array(order))
    rows = flat.to_numpy().reshape(-1, dim)[order]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, dim, dtype=np.int32)), pa.array(rows.reshape(-1)))


def _tokens_folded(batches, schema: pa.Schema, names: list):
    for table, runs in _key_runs(batches, schema):
        code = pc.dictionary_encode(table.column("token").combine_chunks()).indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((table.column("pos").to_numpy(), code, runs))
        order = _sorted_by_vector(table, runs, order)
        first = np.flatnonzero(np.append(True, (runs[order][1:] != runs[order][:-1]) | (code[order][1:] != code[order][:-1])))
        ends = np.append(first, len(order))
        vectors = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _taken(table.column("vec").combine_chunks(), order))
        head = order[first]
        key, token, pos = (table.column(i).combine_chunks().take(head) for i in (0, 2, 1))
        out = pa.RecordBatch.from_arrays([key, token, pos, pa.array(np.diff(ends).astype(np.int32)), vectors], names=names)
        yield from row_slices(out, table.nbytes / max(1, out.num_rows))


def vectors_by_token(long: DataFrame | InTask, key_col: str = "article_id", in_runs: bool = False) -> DataFrame | InTask:
    """Per document and token, its vectors in position order (``token -> [vectors]``).

    A group is one token's occurrences in one document, whose whole text is read. With ``in_runs``
    the rows of a key are next to each other (``gathered`` before the vectors were made): they are
    folded where they are and no vector is shuffled; a task holds one key's rows. Rows that are
    ``InTask`` must be so, and stay in their task.
    """
    if in_runs:
        schema = T.StructType([long.schema[key_col], long.schema["token"], T.StructField("first_pos", T.IntegerType()),
                               T.StructField("n_vectors", T.IntegerType()), T.StructField("vectors", T.ArrayType(long.schema["vec"].dataType))])
        fold = lambda batches: _folded(batches, _tokens_folded, schema.names)
        return long.then(fold, schema) if isinstance(long, InTask) else long.select(key_col, "pos", "token", "vec").mapInArrow(fold, schema)
    return (long.groupBy(key_col, "token")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "vec"))).alias("occ"))
            .select(key_col, "token", F.col("occ")[0]["pos"].alias("first_pos"),
                    F.size("occ").alias("n_vectors"), F.transform("occ", lambda o: o["vec"]).alias("vectors")))


def _folded(batches, fold, names: list):
    """``fold`` over the batches under the first one's schema (none: nothing)."""
    batches = iter(batches)
    head = next(batches, None)
    if head is not None:
        yield from fold(chain([head], batches), head.schema, names)


def _maps_folded(batches, schema: pa.Schema, names: list):
    for table, runs in _key_runs(batches, schema):
        keyed = pa.table({"run": runs, "pos": table.column("first_pos"), "token": table.column("token")})
        order = pc.sort_indices(keyed, [("run", "ascending"), ("pos", "ascending"), ("token", "ascending")])
        first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        order = order.to_numpy()
        lists = table.column("vectors").combine_chunks()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)  # at least one vector each
        ends = np.cumsum(counts[order])
        places = np.arange(ends[-1]) + np.repeat((np.cumsum(counts) - counts)[order] - (ends - counts[order]), counts[order])
        vectors = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), _taken(lists.flatten(), places))
        token = table.column("token").combine_chunks().take(pa.array(order))
        maps = pa.MapArray.from_arrays(pa.array(np.append(first, len(runs)).astype(np.int32)), token, vectors)
        out = pa.RecordBatch.from_arrays([table.column(0).combine_chunks().take(pa.array(first)), maps], names=names)
        yield from row_slices(out, table.nbytes / max(1, out.num_rows))


def token_vector_map(by_token: DataFrame | InTask, key_col: str = "article_id", in_runs: bool = False) -> DataFrame | InTask:
    """Nested view ``map<token, array<vector>>`` per document, built after grouping (keys unique).
    ``in_runs`` as in ``vectors_by_token``, whose rows it then takes."""
    if in_runs:
        schema = T.StructType([by_token.schema[key_col], T.StructField("token_vectors", T.MapType(
            by_token.schema["token"].dataType, by_token.schema["vectors"].dataType))])
        fold = lambda batches: _folded(batches, _maps_folded, schema.names)
        return (by_token.then(fold, schema) if isinstance(by_token, InTask)
                else by_token.select(key_col, "token", "first_pos", "vectors").mapInArrow(fold, schema))
    entries = F.sort_array(F.collect_list(F.struct("first_pos", "token", "vectors")))
    return by_token.groupBy(key_col).agg(
        F.map_from_entries(F.transform(entries, lambda s: F.struct(s["token"], s["vectors"]))).alias("token_vectors"))


def flatten_vectors(token_map: Column | pa.Array) -> Column | pa.Array:
    """All vectors of a ``token -> [vectors]`` map as one list (of a column, or of an Arrow array of maps)."""
    if isinstance(token_map, pa.Array):
        entries = token_map.items  # one list of vectors per token
        return pa.ListArray.from_arrays(entries.offsets.take(token_map.offsets), entries.values)
    return F.flatten(F.map_values(token_map))
