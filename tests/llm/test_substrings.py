import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import substring_dedup, suffix_arrays

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("shard", T.StringType()),
                     T.StructField("h", T.StringType()), T.StructField("kept", T.StringType())])


def some_bytes(seed):
    rnd = random.Random(seed)
    out = bytearray()
    while len(out) < 3000:
        out += rnd.choice([bytes(rnd.choices(b"ab\x00", k=rnd.randint(1, 9))), b"a" * rnd.randint(1, 300), bytes(out[rnd.randrange(len(out) + 1):])[:400]])
    return bytes(out)


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa" * 40, b"\x00" * 50, bytes(range(256)), some_bytes(1), some_bytes(2)])
def test_suffix_order_and_prefixes(data):
    text = np.frombuffer(data, np.uint8)
    order = suffix_arrays.suffix_array(text)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    shared = suffix_arrays.common_prefixes(text, order, 60, lane=37)
    for r in range(1, len(want)):
        a, b = data[want[r - 1]:], data[want[r]:]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[r] == min(n, 60)


def brute(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    seen, out = set(), {}
    for i in order:
        data = (rows[i][1] or "").encode()
        hit = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s:s + length]
            if w in seen:
                hit[s:s + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(c for c, x in zip(data, hit) if not x)
        spans = sum(1 for k, x in enumerate(hit) if x and (k == 0 or not hit[k - 1]))
        out[i] = (rows[i][0], len(data), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(2, 8)))
    passages = [" ".join(word() for _ in range(rnd.randint(15, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 3)
            parts += [p[a:], " ".join(word() for _ in range(rnd.randint(0, 9)))]
        rows.append((i, rnd.choice([" ", "\n"]).join(parts), "c", "c", "c"))
    for i in range(n, n + 30):  # near and exact copies
        t = rows[rnd.randrange(20)][1]
        k = rnd.randrange(len(t) + 1)
        rows.append((i, t if i % 3 else t[:k] + "zz" + t[k:], "c", "c", "c"))
    rows += [(1000, None, "", "", ""), (1001, "", "", "", ""), (1002, "x" * 4000, "", "", ""), (1003, "ab" * 900, "", "", ""), (1004, "short", "", "", ""),
             (1005, passages[0], "", "", ""), (None, passages[0], "", "", ""), (1006, "x" * 99, "", "", ""), (1007, "\x00" * 300, "", "", ""), (1008, "x" * 100, "", "", "")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,parts", [(1, 3), (2, 1), (5, 6)])
def test_query_equals_brute_force(spark, seed, parts):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    got = sorted((tuple(r) for r in substring_dedup.remaining(df).collect()), key=str)
    assert got == brute(rows, 100)


def settled(rows, length, per_shard):
    """All steps in numpy, as the tasks run them, with tiny blocks and shards."""
    shards = []
    for k in range(0, len(rows), per_shard):
        part = rows[k:k + per_shard]
        texts = [(r[1] or "").encode() for r in part]
        ids = np.array([substring_dedup.LAST if r[0] is None else r[0] for r in part], np.int64)
        import zstandard
        shards.append(substring_dedup.Shard(k, ids.tobytes(), np.array(list(map(len, texts)), np.int64).tobytes(),
                                            zstandard.ZstdCompressor().compress(b"".join(texts))))
    return shards


def test_tiny_blocks_and_hot_hashes(monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 600)
    rows = corpus(7)
    length, removed, pieces, hot = 100, {}, [], []
    shards = settled(rows, length, 9)
    counts = {}
    for s in shards:
        for number, lo, hi in s.blocks(length):
            _, picked, place = substring_dedup.block_windows(s, lo, hi, length)
            for h in {(h, p) for h, p in zip(picked.tolist(), place.tolist())}:
                counts.setdefault(h[0], []).append((s.shard, number))
    modes = {h: 0 if len(set(x)) == 1 else 1 + (len(x) > 6) for h, x in counts.items() if len(x) > 1}
    found = np.array(sorted(modes), np.uint64)
    mode = np.array([modes[h] for h in found.tolist()], np.int64)
    for s in shards:
        for _, lo, hi in s.blocks(length):
            for batch in substring_dedup._block_rows(s, lo, hi, found, mode, length):
                for r in batch.to_pylist():
                    if r["kind"] == 0:
                        removed.setdefault((r["shard"], r["row"]), []).append((r["start"], r["n"]))
                    else:
                        (pieces if r["kind"] == 1 else hot).append(r)
    import pyarrow as pa
    age = lambda r: (r["doc"], r["shard"], r["row"], r["start"])
    pieces.sort(key=lambda r: (r["h"], *age(r)))
    names = ["h", "shard", "row", "start", "n", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    monkeypatch.setattr(substring_dedup, "MERGE_PIECES", 50)
    monkeypatch.setattr(substring_dedup, "MERGE_WINDOWS", 500)
    batches = [pa.record_batch([pa.array([r[c] for r in pieces[a:a + 20]], k) for c, k in zip(names, kinds)], names) for a in range(0, len(pieces), 20)]
    for out in substring_dedup._merge_pieces(length)(iter(batches)):
        for r in out.to_pylist():
            removed.setdefault((r["shard"], r["row"]), []).append((r["start"], r["n"]))
    oldest = {}
    for r in hot:
        k = (r["h"], r["h2"])
        oldest[k] = min(oldest.get(k, age(r)), age(r))
    for r in hot:
        if age(r) != oldest[(r["h"], r["h2"])]:
            removed.setdefault((r["shard"], r["row"]), []).append((r["start"], 1))
    assert hot and pieces
    got = []
    for s in shards:
        g = [(row, a, n) for (sh, row), x in removed.items() if sh == s.shard for a, n in x]
        r = {"shard": s.shard, "ids": s.ids.tobytes(), "sizes": s.sizes.tobytes(), "full": s.sizes.tobytes(), "flags": bytes(int(i == substring_dedup.LAST) for i in s.ids),
             "rows": [x[0] for x in g], "starts": [x[1] for x in g], "ns": [x[2] for x in g]}
        import zstandard
        r["blob"] = zstandard.ZstdCompressor().compress(s.text.tobytes())
        got += [tuple(x.values()) for x in substring_dedup._finish(r, length, False).to_pylist()]
    assert sorted(got, key=str) == brute(rows, length)


def test_text_is_cut_and_rows_stay(spark):
    rows = corpus(4, 40)
    df = spark.createDataFrame(rows, DOCS)
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert sum(len(r.text or "") for r in out.collect()) < sum(len(r[1] or "") for r in rows)
    assert substring_dedup.remaining(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "q" * 150, "", "", "")] * 2, DOCS)
    assert sorted(r.n_removed for r in substring_dedup.remaining(twice).collect()) == [149, 150]


def test_a_copy_does_not_take_other_texts_of_its_id(spark):
    rnd = random.Random(9)
    a, b = ("".join(rnd.choices("abcdefgh ", k=400)) for _ in range(2))
    rows = [(3, a, "", "", ""), (5, a, "", "", ""), (5, b, "", "", ""), (7, b, "", "", "")]
    got = sorted((r.id, r.n_removed, r.kept) for r in substring_dedup.remaining(spark.createDataFrame(rows, DOCS), texts=True).collect())
    assert got == [(3, 0, a), (5, 0, b), (5, 400, ""), (7, 400, "")]


def test_texts_are_not_shuffled_to_find_whole_copies(spark, tmp_path, monkeypatch):
    """Also where no table is small enough to be sent to all tasks: shards are packed without an exchange."""
    rnd = random.Random(11)
    texts = ["".join(rnd.choices("abcdefgh ", k=3000)) for _ in range(40)]
    rows = [(i, texts[i % 40], "", "", "") for i in range(80)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "docs"))
    docs, plans, written = spark.read.parquet(str(tmp_path / "docs")), {}, substring_dedup.written

    def noted(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, tag)

    monkeypatch.setattr(substring_dedup, "written", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.id: (r.n_removed, r.n_spans) for r in substring_dedup.remaining(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plans["shards"]
    assert got == {i: (0, 0) if i < 40 else (3000, 1) for i in range(80)}
