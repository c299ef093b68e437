"""Quality rules whose cutoffs are certified on labelled holdouts, per stratum.

Each document is scored by a few rules (larger = worse). For every stratum a path of ever
stricter cutoffs is laid through the rules' tails on one half of the good labelled
documents; the other half (the holdout) then tests the path from its loosest step on: a step
passes if the exact binomial test shows that at most ``alpha`` of good documents are
rejected, at a level corrected for the number of strata (Bonferroni) and, by stopping at the
first step that fails, for the number of steps (fixed-sequence testing). The strictest step
that passed gives the cutoffs; a stratum in which none passes rejects nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, utf8, written

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: steps of a rule's score; scores beyond the range fall into the last step
STEPS = 1000
#: parts of the good documents that each rule's cutoff may leave above it, loosest first
TAILS = tuple([0.0] + [round(1.25 ** k * 1e-4, 6) for k in range(26)])
MAX_FALSE_REJECTION, ERROR_RATE = 0.02, 0.05


def repeat_words(tokens: list, window: int = WINDOW) -> int:
    """Words inside word windows that occur at least twice in the text (first included)."""
    n = len(tokens) - window + 1
    if n < 2 or len(set(tokens)) == len(tokens):
        return 0
    # hashes only pick out the windows to look at; equality is decided on the words
    ids = np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe).tolist()
    if not at:
        return 0
    seen: dict = {}
    covered = np.zeros(len(tokens) + 1, np.int64)
    for i in at:
        seen.setdefault(tuple(tokens[i:i + window]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered[places] += 1
            covered[[p + window for p in places]] -= 1
    return int((np.cumsum(covered) > 0).sum())


_NOT_CONT = bytes(range(0x80, 0xC0))


def measure(text: bytes) -> tuple:
    """Base counts of one whole text, then counts that the other rules use."""
    tokens = text.split()
    joined = b"".join(tokens)
    seen: set = set()
    dup_lines = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    chars = len(joined.translate(None, _NOT_CONT))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    capitals = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (len(tokens), chars, symbols, dup_lines, repeat_words(tokens), lines, capitals, len(set(tokens)))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_distinct"]


def base_counts(docs: DataFrame, id_col: str, text_col: str, stratum_col: str, key_col: str | None = None) -> DataFrame:
    """``(id, stratum, counts…, key, base_failed)`` of every whole text (null: no words); ``key`` is
    null without a ``key_col``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in utf8(batch.column(2))]
            cols = zip(*rows) if rows else [[]] * len(COUNTS)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols), batch.column(3)],
                                  ["id", "stratum", *COUNTS, "key"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                       F.col(text_col).alias("text"), (F.col(key_col) if key_col else F.lit(None)).cast("string").alias("key"))
    out = read.mapInArrow(run, "id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS) + ", key string")
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def rule_steps() -> dict:
    """Rule name -> its score as a step 0..STEPS (larger = worse); a step is 1/1000 of the
    share or of the word-length range."""
    def step(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(STEPS), F.floor(x * STEPS))).cast("int")

    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": step(F.col("n_symbols") / chars),
        "dup_lines": step(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": step(F.col("n_repeat_words") / n),
        "capitals": step(F.col("n_capitals") / chars),
        "same_words": step(1 - F.col("n_distinct") / n),
        "long_words": step(chars / n / 20),
        "short_words": step(1 - chars / n / 20),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most ``k`` of ``n``) at rate ``p``: the exact p-value of "the rate is p or more"."""
    if k >= n:
        return 1.0
    lp, lq = log(p), log(1 - p)
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * lp + (n - i) * lq for i in range(k + 1)]
    top = max(logs)
    return min(1.0, float(np.exp(top) * np.exp(np.array(logs) - top).sum()))


def tail_cutoffs(steps: np.ndarray, counts: np.ndarray, total: int, tails=TAILS) -> list:
    """For each tail the smallest step that at most this part of the good documents exceeds."""
    per = np.zeros(STEPS + 1, np.int64)
    np.add.at(per, steps, counts)
    above = total - np.cumsum(per)
    return [int(np.flatnonzero(above <= t * total)[0]) for t in tails]


def strictest_step(failed_at: np.ndarray, counts: np.ndarray, n_strata: int, alpha: float, delta: float) -> int:
    """Last step of the path that passes, -1 if none: ``counts`` holdout documents fail from
    step ``failed_at`` on (``len(TAILS)``: never)."""
    per = np.zeros(len(TAILS) + 1, np.int64)
    np.add.at(per, failed_at, counts)
    total, rejected, best = int(per.sum()), np.cumsum(per), -1
    for step in range(len(TAILS)):
        if total == 0 or binomial_tail(int(rejected[step]), total, alpha) > delta / n_strata:
            break
        best = step
    return best


def certified_cutoffs(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                      alpha: float = MAX_FALSE_REJECTION, delta: float = ERROR_RATE) -> DataFrame:
    """``(stratum, <rule>_max…)`` for the strata in which some cutoffs are certified.

    ``scored`` has ``id, stratum, base_failed`` and one step column per rule. Good documents
    are those labelled 1 that pass the base rules; contradictory or null labels count for
    nothing. Only histograms per stratum (at most rules x 1001 rows each) are grouped.
    """
    rules = list(rule_steps())
    good = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("q")).where("q = 1").select("id"))
    held = written(scored.where("not base_failed").join(good, "id", "left_semi")
                   .withColumn("half", F.pmod(F.xxhash64(F.lit("holdout"), "id"), F.lit(2)))
                   .select("stratum", "half", *rules), "quality")
    n_strata = max(1, held.select("stratum").distinct().count())
    long = held.where("half = 0").select("stratum", F.explode(F.map_from_arrays(
        F.array(*[F.lit(r) for r in rules]), F.array(*[F.col(r) for r in rules]))).alias("rule", "step"))
    histogram = long.groupBy("stratum", "rule", "step").agg(F.count(F.lit(1)).alias("n"))

    def path(pdf):
        import pandas as pd
        cuts = tail_cutoffs(pdf["step"].to_numpy(), pdf["n"].to_numpy(), int(pdf["n"].sum()))
        return pd.DataFrame({"stratum": pdf["stratum"].iloc[:1], "rule": pdf["rule"].iloc[:1], "cuts": [cuts]})

    paths = (histogram.groupBy("stratum", "rule").applyInPandas(path, "stratum string, rule string, cuts array<int>")
             .groupBy("stratum").pivot("rule", rules).agg(F.first("cuts")))
    paths = paths.select("stratum", *[F.col(r).alias(f"{r}_path") for r in rules])
    # a path gets stricter step by step: a document fails from the first cutoff below its score on
    first_fail = F.least(*[F.expr(f"size(filter({r}_path, c -> c >= {r}))") for r in rules])
    tested = (held.where("half = 1").join(paths, "stratum").withColumn("failed_at", first_fail)
              .groupBy("stratum", "failed_at").agg(F.count(F.lit(1)).alias("n")))

    def choose(pdf):
        import pandas as pd
        step = strictest_step(pdf["failed_at"].to_numpy(), pdf["n"].to_numpy(), n_strata, alpha, delta)
        return pd.DataFrame({"stratum": pdf["stratum"].iloc[:1], "step": [step]})

    steps = tested.groupBy("stratum").applyInPandas(choose, "stratum string, step int").where("step >= 0")
    return paths.join(steps, "stratum").select("stratum", *[F.expr(f"{r}_path[step]").alias(f"{r}_max") for r in rules])


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     stratum_col: str = "lang", alpha: float = MAX_FALSE_REJECTION, delta: float = ERROR_RATE,
                     key_col: str | None = None) -> DataFrame:
    """``(id, counts…, base_failed, kept, key)`` per row of ``docs`` (``key``: its ``key_col``, or null).

    ``kept`` is false if the base rules fail or any rule's score is above the cutoff certified
    for the row's stratum; strata without certified cutoffs (too few labels, no labels, empty
    label table) keep what the base rules keep. Null and empty texts have no words and fail
    the base rules; a null stratum is a stratum of its own; null ids and repeated rows are
    judged like any other; other columns are ignored.
    """
    rules = list(rule_steps())
    counts = base_counts(docs, id_col, text_col, stratum_col, key_col)
    scored = written(counts.select("*", *[c.alias(r) for r, c in rule_steps().items()]), "quality")
    cutoffs = certified_cutoffs(scored, labels, id_col, alpha=alpha, delta=delta)
    fails = F.greatest(*[F.coalesce(F.expr(f"{r} > {r}_max"), F.lit(False)) for r in rules])
    return (scored.join(cutoffs, "stratum", "left")
            .withColumn("kept", ~F.col("base_failed") & ~fails)
            .select("id", *COUNTS, "base_failed", "kept", "key"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str = "lang", alpha: float = MAX_FALSE_REJECTION, delta: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the rows that :func:`quality_verdicts` rejects (all columns stay).

    Every row is judged by itself: rows with null ids or ids that several rows share stay or go by
    their own text.
    """
    rows, key = keyed_rows(docs)
    verdicts = quality_verdicts(rows, labels, id_col, text_col, stratum_col, alpha, delta, key)
    return rows.join(verdicts.where("kept").select(F.col("key").alias(key)), key, "left_semi").drop(key)
