import hashlib
import random
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import exact_dedup

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("key", T.StringType()), T.StructField("n", T.StringType())])
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def brute_force(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = [i == keep for i in ids]
        if sum(kept) > 1:  # repeated rows: one stays
            first = kept.index(True)
            kept = [k == first for k in range(len(ids))]
        out += [(i, keep, len(ids), k, hashlib.sha256(text.encode()).hexdigest()) for i, k in zip(ids, kept)]
    return sorted(map(str, out))


def odd_rows():
    rnd = random.Random(5)
    words = ["a", "A", "é", "É", "K", "K", "ß", "ẞ", " ", "\n", "İ", "x"]
    rows = [(i, "".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))) for i in range(600)]
    rows += [(None, "only null ids"), (None, "ONLY null ids"), (None, "a"), (7000, None), (7001, ""), (7002, "long " * 50_000),
             (7003, "LONG " * 50_000), (7004, "same"), (7004, "same"), (7004, "other"), (7004, "same")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("capacity,bits,hot,few", [(1024, 64, 4096, 1 << 20), (8, 64, 5, 0), (4, 3, 20, 0), (16, 64, 5, 1 << 20)])
def test_equal_to_brute_force(spark, monkeypatch, capacity, bits, hot, few):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_KEYS", few)
    monkeypatch.setattr(exact_dedup, "FOLD_BYTES", 1000)
    rows = odd_rows()
    got = exact_dedup.exact_groups(frame(spark, rows).repartition(5), capacity=capacity, key_bits=bits).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_force(rows)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_overfull_buckets_are_split(spark):
    """Keys crowded under one prefix: only their buckets go deeper, and every key has one bucket."""
    crowded = spark.range(400).select((F.col("id") * (1 << 44) + 3).alias("key"), F.lit(1).cast("long").alias("n"))
    spread = spark.range(400).select((F.xxhash64("id")).alias("key"), F.lit(2).cast("long").alias("n"))
    index = exact_dedup.ExtendibleIndex(crowded.unionByName(spread), capacity=100)
    rows, directory = index.buckets.collect(), {r.bucket: r for r in index.directory.collect()}
    assert len(rows) == 800 == len({r.key for r in rows})
    assert max(r.depth for r in directory.values()) > 11 and min(r.depth for r in directory.values()) <= 4
    for bucket, d in directory.items():
        mine = [r.key for r in rows if r.bucket == bucket]
        assert len(mine) == d["keys"] <= 100
        assert all((k % 2 ** 64) >> (64 - d.depth) | 1 << d.depth == bucket for k in mine)
