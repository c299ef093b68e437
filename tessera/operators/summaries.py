"""Summary generation with a user's generator, n-best hypotheses, best summary, attach.

``make_generator()`` is called once per Python worker and returns
``fn(src[B, L], segs[B, L], mask[B, L]) -> list (per row) of [(score, ids), ...]``. Rows are
fed in micro-batches of ``batch_size``; the n-best table comes back as rows
``(key, hyp_id, ids, score)``. Choosing, detokenizing and attaching are Spark operators.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import detokenize
from .embed import worker_model
from .tokens import Vocabulary, ids_to_tokens


def summarize(encoded: DataFrame, make_generator, name: str, key_col: str = "document_name",
              batch_size: int = 1) -> DataFrame:
    """n-best table ``(key, hyp_id, ids array<int>, score double)`` per encoded row."""
    key_field = encoded.schema[key_col]
    model_key = f"{name}-{uuid.uuid4().hex}"  # one load per worker and call, never another's model
    schema = T.StructType([key_field, T.StructField("hyp_id", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType())])

    def run(batches):
        gen = worker_model(model_key, make_generator)
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            mats = []
            for c in ("src", "segs", "mask_src"):
                col = rb.column(c)
                L = int(pc.max(pc.list_value_length(col)).as_py())
                mats.append(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, L))
            keys, hyp, ids, scores = [], [], [], []
            key_arr = rb.column(key_col).to_pylist()
            for s in range(0, n, batch_size):
                out = gen(*(m[s:s + batch_size] for m in mats))
                for r, hyps in enumerate(out):
                    for j, (score, seq) in enumerate(hyps):
                        keys.append(key_arr[s + r])
                        hyp.append(j)
                        ids.append([int(x) for x in seq])
                        scores.append(float(score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, type=pa.from_numpy_dtype(np.int64) if isinstance(key_field.dataType, T.LongType)
                          else pa.string()),
                 pa.array(hyp, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(scores, pa.float64())],
                names=[key_col, "hyp_id", "ids", "score"])

    return encoded.select(key_col, "src", "segs", "mask_src").mapInArrow(run, schema)


def lead_generator(cls_id: int, sep_id: int, eos_id: int, n_best: int = 3):
    """A stand-in generator: hypothesis j = the j-th encoded line, score = minus its length.

    Deterministic and model-free, for tests and examples.
    """
    def make():
        def gen(src, segs, mask):
            out = []
            for row in src:
                starts = np.flatnonzero(row == cls_id)
                hyps = []
                for j, st in enumerate(starts[:n_best]):
                    end = np.flatnonzero(row[st:] == sep_id)
                    body = row[st + 1: st + end[0]] if len(end) else row[st + 1:]
                    hyps.append((-float(len(body)), list(body) + [eos_id]))
                out.append(hyps)
            return out
        return gen
    return make


def best_summary(nbest: DataFrame, vocab: Vocabulary, key_col: str = "document_name",
                 strip_end: bool = False, end_token: str = "[unused1]") -> DataFrame:
    """Highest score per document (ties: lower ``hyp_id``), ids -> tokens -> text."""
    w = Window.partitionBy(key_col).orderBy(F.col("score").desc(), F.col("hyp_id"))
    best = nbest.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    toks = ids_to_tokens(best, vocab, "ids", "tokens")
    body = F.filter("tokens", lambda t: t != end_token) if strip_end else F.col("tokens")
    return toks.select(key_col, "score", detokenize(body).alias("summary"))


def attach_summaries(summaries: DataFrame, articles: DataFrame, key_col: str) -> DataFrame:
    """Put ``paper_id`` and ``title`` next to each summary by key (never by position)."""
    return summaries.join(articles, key_col, "inner")
