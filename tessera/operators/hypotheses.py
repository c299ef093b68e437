"""Beam-search rules over an n-best candidate table (one row per beam x candidate token).

Columns used: ``doc_id, step, beam, cand, token, token_id, alive (array<string>: the beam's
sequence so far, begin token first), beam_logprob, token_logprob``. All rules are column
expressions or windows partitioned by document, so they scale with the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import EOS
from ..functions.strings import detokenize, normalize_whitespace
from ..functions.vectors import length_penalty

BEAM_SIZE = 5
MIN_LENGTH = 50
MAX_LENGTH = 200
ALPHA = 0.95
SUPPRESSED = -1e20  # end token before the minimum length
BLOCKED = -10e20  # repeated trigram


def suppress_early_end(df: DataFrame, min_length: int = MIN_LENGTH, end_token: str = EOS) -> DataFrame:
    """While ``step < min_length`` the end token's log-prob becomes -1e20."""
    return df.withColumn("token_logprob", F.when((F.col("step") < min_length) & (F.col("token") == end_token),
                                                 F.lit(SUPPRESSED)).otherwise(F.col("token_logprob")))


def loop_length_penalty(step, alpha: float = ALPHA) -> Column:
    """``((5 + (step + 1)) / 6) ** alpha`` as computed inside the decoding loop."""
    s = step if isinstance(step, Column) else F.col(step)
    return F.pow((F.lit(5.0) + (s + 1)) / F.lit(6.0), F.lit(alpha))


def candidate_score(df: DataFrame, alpha: float = ALPHA, penalty: str = "loop") -> DataFrame:
    """``log_prob`` = beam log-prob + token log-prob; ``score`` = log_prob / length penalty.

    ``penalty``: ``loop`` (the decoder's own form), ``wu``, ``avg`` or ``none`` on length
    ``step + 1``.
    """
    lp = loop_length_penalty("step", alpha) if penalty == "loop" else length_penalty(penalty, F.col("step") + 1, alpha)
    return (df.withColumn("log_prob", F.col("beam_logprob") + F.col("token_logprob"))
            .withColumn("penalty", lp)
            .withColumn("score", F.col("log_prob") / F.col("penalty")))


def repeats_last_trigram(seq: Column) -> Column:
    """True if the sequence (longer than 3 tokens, begin token counted) has more than 3
    detokenized words and its last trigram occurs earlier.

    String form, no array lambdas: words are joined by single spaces, so the last trigram
    repeats exactly when `` a b c `` (its words framed by spaces) first occurs before the
    end of `` w0 w1 ... `` .
    """
    norm = normalize_whitespace(detokenize(seq))
    n_words = F.when(norm == "", F.lit(0)).otherwise(F.size(F.split(norm, " ", -1)))
    framed = F.concat(F.lit(" "), norm, F.lit(" "))
    target = F.concat(F.lit(" "), F.substring_index(norm, " ", -3), F.lit(" "))
    first = F.call_function("instr", framed, target)  # 1-based position of the first occurrence
    return (F.size(seq) > 3) & (n_words > 3) & (first < F.length(framed) - F.length(target) + 1)


def block_repeated_trigram(df: DataFrame, seq_col: str = "alive") -> DataFrame:
    """Score of every candidate of a beam whose sequence repeats its last trigram -> -10e20."""
    return (df.withColumn("blocked", repeats_last_trigram(F.col(seq_col)))
            .withColumn("score", F.when(F.col("blocked"), F.lit(BLOCKED)).otherwise(F.col("score"))))


def candidate_topk(df: DataFrame, beam_size: int = BEAM_SIZE, group_cols=("doc_id", "step")) -> DataFrame:
    """The ``beam_size`` best candidates per document and step: score descending, then flat index
    (beam, then token id) ascending. ``topk_log_probs`` = score times the penalty again."""
    w = Window.partitionBy(*group_cols).orderBy(F.col("score").desc(), F.col("beam"), F.col("token_id"))
    return (df.withColumn("cand_rank", F.row_number().over(w)).filter(F.col("cand_rank") <= beam_size)
            .withColumn("topk_log_prob", F.col("score") * F.col("penalty")))


def best_hypothesis(df: DataFrame, finished_col: str = "finished", order_cols=("step", "cand_rank"),
                    keep_unfinished: bool = False) -> DataFrame:
    """Highest score per document among finished hypotheses; ties keep the first finished.

    With ``keep_unfinished`` a document in which nothing has finished keeps its best
    unfinished hypothesis (``finished_col`` stays false on it).
    """
    first = [F.col(finished_col).desc()] if keep_unfinished else []
    w = Window.partitionBy("doc_id").orderBy(*first, F.col("score").desc(), *[F.col(c) for c in order_cols])
    rows = df if keep_unfinished else df.filter(F.col(finished_col))
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def hypothesis_text(seq: Column, strip_end: bool = False, begin_token: str = "[unused0]") -> Column:
    """Detokenized hypothesis (begin token removed; the end token kept unless asked)."""
    body = F.filter(seq, lambda t: t != begin_token)
    if strip_end:
        body = F.filter(body, lambda t: t != EOS)
    return detokenize(body)


def close_documents(top: DataFrame, finished_col: str = "finished") -> DataFrame:
    """The end rule over steps, on the ``candidate_topk`` rows of every step.

    A document is closed by the first step whose best candidate (``cand_rank`` 1) is finished: all
    candidates of that step then count as finished, and later steps never took place. What
    finished in earlier steps stays. A document that no step closes keeps all its rows.
    One window over a document's ``beam_size`` rows per step, on the partitioning the
    top-k has already.
    """
    closing = F.min(F.when((F.col("cand_rank") == 1) & F.col(finished_col), F.col("step"))).over(Window.partitionBy("doc_id"))
    return (top.withColumn("_closing", closing)
            .filter(F.col("_closing").isNull() | (F.col("step") <= F.col("_closing")))
            .withColumn(finished_col, F.col(finished_col) | F.coalesce(F.col("step") == F.col("_closing"), F.lit(False)))
            .drop("_closing"))


def rerank_hypotheses(cands: DataFrame, beam_size: int = BEAM_SIZE, min_length: int = MIN_LENGTH,
                      alpha: float = ALPHA, max_length: int = MAX_LENGTH) -> DataFrame:
    """``suppress_early_end`` -> ``candidate_score`` -> ``block_repeated_trigram`` ->
    ``candidate_topk`` -> ``close_documents`` -> ``best_hypothesis``.

    A hypothesis is finished by the end token, by reaching ``max_length``, or by standing in the
    step that closes its document; a document in which nothing has finished comes back with
    its best unfinished one and ``finished`` false.

    Rows are shuffled once, by document, which serves all three windows, and carry the hypothesis as
    its text: the sequence (24 bytes and more for a token) stays behind.
    """
    scored = block_repeated_trigram(candidate_score(suppress_early_end(cands, min_length), alpha))
    scored = (scored.withColumn("text", hypothesis_text(F.concat(F.col("alive"), F.array(F.col("token")))))
              .select("doc_id", "step", "beam", "cand", "token", "token_id", "score", "penalty", "text")
              .repartition("doc_id"))
    top = candidate_topk(scored, beam_size).withColumn(
        "finished", (F.col("token") == EOS) | (F.col("step") + 1 >= max_length))
    best = best_hypothesis(close_documents(top), keep_unfinished=True)
    return best.select("doc_id", "beam", "cand", "score", "finished", "text")
