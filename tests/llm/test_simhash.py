import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from tessera.llm import simhash
from tessera.llm.components import connected_components, local_roots

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("fp", T.StringType()), T.StructField("component", T.StringType())])


def brute_fp(text):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, bits=4):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for _ in range(1500)]
    fps = np.unique(np.array([base[i % 60] ^ f for i, f in enumerate(flips)], np.uint64))
    a, b = simhash.trie_links(fps, np.zeros(len(fps), np.int64), 4)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert got == want and len(got) > 100
    assert len(a) == len(got)


def test_links_lose_nothing_in_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_GROUP", 50)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    fps = {base}
    while len(fps) < 400:
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, 5, replace=False)))
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in sorted(fps)]
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    got = {r.node: r.component for r in connected_components(simhash.near_links(reps)).collect()}
    want = brute_groups({i: f & (1 << 64) - 1 for i, f in enumerate(signed)})
    assert {i: got.get(i, i) for i in want} == want


def test_groups_equal_brute_force(spark):
    texts = ["", None, " \t\n", "one", "ONE", "one two three", "One two\tthree", "a b c d e f g h i j k",
             "a b c d e f g h i j k", "a b c d e f g h i j l", "É é x y", "word " * 5000]
    words = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = list(words)
        w[rng.integers(60)] = "other"
        texts.append(" ".join(w))
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.near_copy_groups(df).collect()}
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    comp = brute_groups(fps)
    assert got == {i: (fps[i], comp[i]) for i in fps}
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(comp.values())


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_copy_groups(empty).count() == 0
    assert simhash.drop_near_copies(empty).count() == 0
    df = spark.createDataFrame([(None, "x y z", "", ""), (4, "x y z", "", ""), (4, "x y z", "", "")], DOCS)
    assert sorted((r.id or -1, r.component) for r in simhash.near_copy_groups(df).collect()) == [(-1, 4), (4, 4), (4, 4)]


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    n = 80
    pairs = rng.integers(0, n, (70, 2)).tolist() + [[i, i + 1] for i in range(100, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    a, b = np.array(pairs).T
    root = local_roots(200, np.minimum(a, b), np.maximum(a, b))
    assert {k: int(root[k]) for k in got} == got
    assert set(got) == {x for p in pairs for x in p if p[0] != p[1]}
