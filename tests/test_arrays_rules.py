"""Array rules: pair truncation, segments, padding, trigrams, top-k eviction."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators.hypotheses import repeats_last_trigram


def pop_rule(la, lb, m):
    while la + lb > m:
        if la > lb:
            la -= 1
        else:
            lb -= 1
    return la, lb


def test_truncate_pair_exhaustive(spark):
    cases = [(la, lb, m) for la in range(0, 25) for lb in range(0, 25) for m in range(0, 30, 3)]
    df = spark.createDataFrame(cases, "la int, lb int, m int")
    out = []
    for m in sorted({c[2] for c in cases}):
        ka, kb = A.truncate_pair_lengths(F.col("la"), F.col("lb"), m)
        out += [(r["la"], r["lb"], m, r["ka"], r["kb"])
                for r in df.filter(F.col("m") == m).select("la", "lb", ka.alias("ka"), kb.alias("kb")).collect()]
    for la, lb, m, ka, kb in out:
        assert (ka, kb) == pop_rule(la, lb, m)


def py_segments(seq, sep):
    n, out = -1, []
    for s in seq:
        if s == sep:
            n += 1
        out.append(n % 2)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_segment_ids_property(spark, seq):
    df = spark.createDataFrame([(seq,)], "s array<int>")
    got = df.select(A.segment_ids(F.col("s"), 1).alias("g")).first()["g"]
    assert list(got) == py_segments(seq, 1)


def test_truncate_or_pad_and_mask(spark):
    df = spark.createDataFrame([([5, 0, 7],), ([1, 2, 3, 4, 5, 6],), ([],)], "s array<int>")
    rows = df.select(A.truncate_or_pad(F.col("s"), 4, 0).alias("p")).select(
        "p", A.build_mask(F.col("p"), 0).alias("m")).collect()
    assert [list(r["p"]) for r in rows] == [[5, 0, 7, 0], [1, 2, 3, 4], [0, 0, 0, 0]]
    assert [list(r["m"]) for r in rows] == [[1, 0, 1, 0], [1, 1, 1, 1], [0, 0, 0, 0]]


def py_block(words_in):
    words = " ".join(words_in).replace(" ##", "").split()
    if len(words_in) <= 3 or len(words) <= 3:
        return False
    tri = [(words[i - 1], words[i], words[i + 1]) for i in range(1, len(words) - 1)]
    return tuple(tri[-1]) in tri[:-1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "##b", "c"]), max_size=10))
def test_trigram_block_property(spark, toks):
    df = spark.createDataFrame([(toks,)], "t array<string>")
    assert df.select(repeats_last_trigram(F.col("t")).alias("b")).first()["b"] == py_block(toks)


def eviction_loop(dists, k):
    ids, ds = [], []
    for i, d in enumerate(dists):
        ids.append(i)
        ds.append(d)
        if len(ids) > k:
            j = max(range(len(ds)), key=lambda x: (ds[x], -x))  # first maximum
            del ids[j], ds[j]
    return sorted(ids)


def test_topk_matches_eviction_loop(spark):
    rng = random.Random(7)
    rows, expect = [], {}
    for q in range(30):
        dists = [rng.choice([0.1, 0.2, 0.3, 0.4]) for _ in range(rng.randint(1, 25))]
        rows += [(q, i, d) for i, d in enumerate(dists)]
        expect[q] = eviction_loop(dists, 5)
    df = spark.createDataFrame(rows, "query_id long, article_id long, distance double")
    from tessera.operators.search import topk_closest
    got = {}
    for r in topk_closest(df, 5).collect():
        got.setdefault(r["query_id"], []).append(r["article_id"])
    assert {q: sorted(v) for q, v in got.items()} == expect


def test_segment_ids_window_form_equals_row_form(spark):
    from tessera.operators.tokens import segment_ids_long
    rows = [(0, [1, 5, 1, 7, 7, 0, 0]), (1, [5, 5, 1]), (2, [1])]
    df = spark.createDataFrame(rows, "k int, s array<int>")
    per_row = {r["k"]: list(r["g"]) for r in df.select("k", A.segment_ids(F.col("s"), 1).alias("g")).collect()}
    long = df.select("k", F.posexplode("s").alias("pos", "id"))
    win = segment_ids_long(long, "k", "pos", "id", 1).orderBy("k", "pos").collect()
    by_key = {}
    for r in win:
        by_key.setdefault(r["k"], []).append(r["seg"])
    assert by_key == per_row == {k: py_segments(s, 1) for k, s in rows}


def test_segments_of_a_sequence_over_many_tasks(spark):
    """One sequence of 5,000 ids and some short ones (a null key too), cut into eight tasks."""
    import random

    from tessera.functions.arrays import segment_ids
    from tessera.operators.tokens import segment_ids_long
    rnd = random.Random(9)
    rows = {"long": [rnd.choice([1, 2, 3, 4]) for _ in range(5000)], None: [2, 1, 3, 1], "a": [1], "b": [3, 3], "m": [1, 1, 2, None, 1]}
    table = [(k, i, x) for k, ids in rows.items() for i, x in enumerate(ids)]
    rnd.shuffle(table)
    long = spark.createDataFrame(table, "k string, pos int, id int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = segment_ids_long(long, "k", "pos", "id", 1).collect()
        whole = spark.createDataFrame([(k, [-1 if x is None else x for x in ids]) for k, ids in rows.items()], "k string, ids array<int>")
        want = {r.k: r.s for r in whole.select("k", segment_ids(F.col("ids"), 1).alias("s")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(table) and all(r.seg == want[r.k][r.pos] for r in got)
