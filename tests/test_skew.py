"""Heavy hitters by a sketch, joins that keep them out of the shuffle, tables beyond the broadcast bound."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tessera.operators import embed as E
from tessera.operators import skew
from tessera.operators import tokens as TK
from tessera.plans import model_queries as Q
from tessera.plans import search as P


def _long(spark, n=40_000):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["the", f"w{rnd.randint(0, 5000)}"]) if i % 50 else None) for i in range(n)]
    return spark.createDataFrame(rows, "pos long, token string").repartition(8).cache(), rows


def test_every_frequent_key_is_found(spark):
    df, rows = _long(spark)
    hot = skew.heavy_hitters(df, "token", share=0.01, counters=300)  # fewer counters than keys
    assert hot == ["the"]
    numbers = df.select(F.when(F.col("token") == "the", 7).otherwise(F.col("pos")).alias("id"))
    assert skew.heavy_hitters(numbers, "id", share=0.1, counters=50) == [7]
    counts = Counter(t for _, t in rows if t)
    few = skew.heavy_hitters(df, "token", share=0.0001, counters=20_000)
    assert set(few) >= {t for t, n in counts.items() if n >= 0.0001 * len(rows)}
    assert skew.heavy_hitters(df.limit(0), "token") == []


def test_one_token_at_half_of_all_rows(spark):
    df, rows = _long(spark)
    table = spark.createDataFrame([("the", 1), *[(f"w{i}", i + 2) for i in range(4000)]], "token string, id int")
    small = TK.Vocabulary(table, max_entries=0)
    small._known = {"[UNK]": 0}
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        out = TK.token_ids_long(df, small)
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        got = {r.pos: r.id for r in out.collect()}
        back = {r.pos: r.token for r in TK.id_tokens_long(out.select("pos", "id"), small).collect()}
    finally:
        for k in off:
            spark.conf.unset(k)
    ids = dict(table.collect())
    assert got == {i: ids.get(t, 0) for i, t in rows}
    assert back == {i: t if t in ids else None for i, t in rows}
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_no_hot_key_at_all(spark):
    df = spark.range(100).select(F.col("id").alias("pos"), F.when(F.col("id") > 2, F.col("id").cast("string")).alias("token"))
    out = skew.join_with_hot_keys(df, spark.createDataFrame([("5", 9)], "token string, id int"), "token", share=0.5)
    assert out.count() == 100 and out.filter("id is not null").collect()[0].pos == 5


@pytest.mark.parametrize("query", ["search_model", "micro_batch"])
def test_model_queries_beyond_the_broadcast_bound(spark, monkeypatch, query):
    whole = sorted(map(tuple, Q.QUERIES[query](spark, SF).collect()))
    lookup = P.lookup_encoder
    monkeypatch.setattr(P, "lookup_encoder", lambda s, d: E.LookupEncoder(lookup(s, d).table, max_bytes=1))
    assert sorted(map(tuple, Q.QUERIES[query](spark, SF).collect())) == whole


def test_first_vector_of_long_queries(spark):
    rnd = random.Random(2)
    rows = [(q, [rnd.choice("abcdefgh") + str(rnd.randint(0, n)) for _ in range(n)]) for q, n in enumerate((0, 1, 5, 3000))]
    df = spark.createDataFrame([(q, t, [[float(i)] for i in range(len(t))]) for q, t in rows], "query_id int, tokens array<string>, vecs array<array<float>>")
    got = [(r.query_id, r.tok_no, r.token, r.vec[0]) for r in E.first_vector_per_token(df).collect()]
    want = [(q, k, t, float(toks.index(t))) for q, toks in rows for k, t in enumerate(dict.fromkeys(toks))]
    assert sorted(got) == sorted(want)
