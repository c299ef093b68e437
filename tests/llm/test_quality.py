import re
from math import comb

import numpy as np
from pyspark.sql import types as T

from tessera.llm import quality

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.StringType())])


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    covered = set()
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered.update(range(i, i + 8))
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_measures_equal_brute_force():
    rng = np.random.default_rng(2)
    texts = ["", None, " \n\t ", "a\n\na\n \na", "é ü # $ <b>\x85 x", "one " * 30, "x y z", "a b\nc\ra b"]
    texts += [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) + "\n" * int(rng.integers(0, 2)) + "tail" for _ in range(200)]
    for t in texts:
        assert quality.measure((t or "").encode())[:5] == brute(t), repr(t)


def test_binomial_tail_is_exact():
    for n, k, p in [(10, 3, 0.2), (200, 0, 0.02), (50, 50, 0.5), (300, 9, 0.03)]:
        want = sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality.binomial_tail(k, n, p) - want) < 1e-9


def corpus(n):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(40)]
        good = i % 8 != 0
        rows.append((i, " ".join(words if good else [w + "###" for w in words]), "en" if i % 2 or i % 3 else None, "c", "c"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_cutoffs_reject_bad_and_keep_good(spark):
    rows, labels = corpus(4800)
    df = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels + [(5, None, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.id: r.kept for r in quality.quality_verdicts(df, lab).collect()}
    good = [i for i, q, _ in labels if q]
    assert not any(got[i] for i, q, _ in labels if not q)
    assert np.mean([not got[i] for i in good]) <= quality.MAX_FALSE_REJECTION
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_too_few_labels_keep_what_the_base_rules_keep(spark):
    rows, _ = corpus(30)
    rows += [(100, None, None, "", ""), (101, "", "xx", "", ""), (None, "a b c " * 40, "xx", "", ""), (3, rows[3][1], "en", "", "")]
    df = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.quality_verdicts(df, none).collect()
    assert len(out) == len(rows)
    assert all(r.kept == (not r.base_failed) for r in out)
    assert [r.base_failed for r in out if r.id in (100, 101, None)] == [True] * 3
    assert quality.quality_verdicts(df.limit(0), none).count() == 0


def test_false_rejections_stay_limited_over_many_draws():
    """Over seeded draws the certified rate exceeds alpha no more often than delta allows."""
    rng = np.random.default_rng(11)
    over = 0
    for _ in range(200):
        true = np.array([0.001 * 1.25 ** k for k in range(len(quality.TAILS))]).clip(0, 1)
        u = rng.random(800)
        failed_at = np.searchsorted(true, u, "left")
        step = quality.strictest_step(failed_at, np.ones(800, int), 1, 0.02, 0.05)
        over += step >= 0 and true[step] > 0.02
    assert over <= 200 * 0.05 + 8
