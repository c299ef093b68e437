import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import periodic_runs

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("runs", T.StringType()), T.StructField("n_runs", T.StringType())])


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def brute_force(words):
    """Every stretch by the definition: smallest period, length, and no neighbour extends it."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            if b > a:
                start, stop = a, b + q
                if stop - start >= max(12, 2 * q) and smallest_period(words[start:stop]) == q:
                    out.append((start, stop, q))
            a = b + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rnd):
    words = [rnd.choice("abcde"[:rnd.randint(1, 5)]) for _ in range(rnd.randint(0, 70))]
    for _ in range(rnd.randint(0, 2)):
        period = [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 25))]
        at, part = rnd.randint(0, len(words)), rnd.randint(0, len(period))
        words[at:at] = period * rnd.randint(1, 5) + period[:part]
    return words


def test_runs_equal_brute_force():
    rnd = random.Random(8)
    for _ in range(120):
        docs = [random_words(rnd) for _ in range(rnd.randint(1, 6))]
        got = periodic_runs._document_runs([np.array([ord(w) for w in d], np.int64) for d in docs])
        assert got == [brute_force(d) for d in docs]


def test_grammar_ends_without_repeated_pairs():
    rnd = random.Random(2)
    ids = np.array([rnd.randrange(4) for _ in range(500)], np.int64)
    g = periodic_runs.Grammar(ids, np.array([200, 500]))
    assert len(g.start) < 500 and (g.start < g.middle).all() and (g.middle < g.stop).all()
    for k in range(len(g.start)):  # every derivation spells the same words
        part = ids[g.start[k]:g.stop[k]]
        for u in g.uses[g.first_use[k]:g.first_use[k + 1]]:
            assert np.array_equal(part, ids[u:u + len(part)]) and (u < 200) == (u + len(part) <= 200)


def test_colliding_hashes_fall_back(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BASE", np.uint64(0))  # all hashes but the first id's are zero
    words = [np.array([1, 2, 3] * 5 + [4, 5, 6, 7], np.int64), np.arange(20)]
    assert periodic_runs._document_runs(words) == [[(0, 15, 3)], []]


def expected(i, text):
    words = (text or "").translate(str.maketrans("\t\n\v\f\r", " " * 5)).split(" ")
    words = [w for w in words if w]
    n = len(words)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = brute_force(words)
    best = sorted(runs, key=lambda r: (r[0] - r[1], r[0], r[2]))[:1]
    figures = [(a, b - a, q, 1000 * (b - a) // q) for a, b, q in best] or [(None,) * 4]
    rest = [w for k, w in enumerate(words) if not any(a + q <= k < b for a, b, q in runs)]
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
    return (i, len(runs), *figures[0], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(rest).encode()).hexdigest())


@pytest.mark.parametrize("block", [50, 400_000])
def test_query_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK_WORDS", block)
    rnd = random.Random(3)
    rows = [(i, rnd.choice([" ", "\n", "\t ", "\x0b"]).join(random_words(rnd))) for i in range(150)]
    rows += [(None, "x " * 30), (200, None), (201, ""), (202, " \n "), (203, "a b c\xa0d " * 9), (7, rows[7][1]), (204, "one " * 3000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).repartition(3)
    got = periodic_runs.run_digests(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(i, t)) for i, t in rows)


def test_found_runs_and_empty_table(spark):
    df = spark.createDataFrame([(1, "go a b a b a b a b a b a b stop", None, None)], DOCS)
    row = periodic_runs.find_runs(df).first()
    assert [tuple(r) for r in row.runs] == [(1, 12, 2)] and row.collapsed == "go a b stop"
    assert periodic_runs.run_digests(df.limit(0)).count() == 0 == periodic_runs.find_runs(df.limit(0)).count()
