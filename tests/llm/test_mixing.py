import numpy as np
from pyspark.sql import types as T

from tessera.llm import mixing
from tessera.llm.common import keyed_rows

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("size", T.StringType()), T.StructField("shard", T.StringType())])


def water(sizes, weights, budget=1.5, cap=2):
    left, target, full = budget * sum(sizes), [0.0] * len(sizes), set()
    target = [left * w / sum(weights) for w in weights]
    while any(t > cap * s + 1e-9 for t, s in zip(target, sizes)):
        excess = 0.0
        for i, s in enumerate(sizes):
            if target[i] > cap * s:
                excess += target[i] - cap * s
                target[i] = float(cap * s)
                full.add(i)
        rest = [i for i in range(len(sizes)) if i not in full]
        for i in rest:
            target[i] += excess * weights[i] / sum(weights[j] for j in rest)
    return target


def test_targets_equal_repeated_resharing(spark):
    sizes = [500, 100, 0, 9000, 40, 700, 10, 300]
    df = spark.createDataFrame([(f"0s{i}", s) for i, s in enumerate(sizes)], "sk string, source_size long")
    got = [r.target for r in mixing.source_targets(df).orderBy("sk").collect()]
    want = water(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))])
    assert np.allclose(got, want)
    even = spark.createDataFrame([(f"0s{i}", 100) for i in range(3)], "sk string, source_size long")
    assert np.allclose([r.target for r in mixing.source_targets(even).orderBy("sk").collect()], water([100] * 3, [3, 1, 2]))


def sainte_lague(claims, seats):
    won = [0] * len(claims)
    for _ in range(seats):
        q = [(c / (2 * w + 1), -i) for i, (c, w) in enumerate(zip(claims, won)) if c > 0]
        won[-max(q)[1]] += 1
    return won


def test_apportionment_equals_seat_by_seat(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g in range(12):
        n = int(rng.integers(1, 9))
        claims = [int(x) for x in rng.integers(0, 1000, n)] if g % 3 else [50] * n
        if not sum(claims):
            claims[0] = 7
        seats = int(rng.integers(0, 60))
        want |= {(g, i): w for i, w in enumerate(sainte_lague(claims, seats))}
        rows += [(g, i, c, seats) for i, c in enumerate(claims)]
    df = spark.createDataFrame(rows, "g int, p int, claim long, seats long")
    got = {(r.g, r.p): r.quota for r in mixing.apportion(df, ["g"], ["p"], "claim", "seats").collect()}
    assert got == want


def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(400):
        source = ["a", "b", None, "hot", "hot", "hot"][i % 6]
        out.append((i, " \n".join(f"w{k}" for k in range(int(rng.integers(0, 120)))), source, "clash", "clash"))
    return out + [(900, None, "a", "", ""), (901, "", None, "", ""), (None, "x y", "b", "", ""), (902, "word " * 30_000, "hot", "", "")]


def test_plan_meets_targets_and_reruns_agree(spark):
    df = spark.createDataFrame(rows(), DOCS)
    plan = mixing.mix_plan(df, block=8, shard_words=2000)
    got = sorted(map(tuple, plan.collect()), key=str)
    assert got == sorted(map(tuple, mixing.mix_plan(df.repartition(7), block=8, shard_words=2000).collect()), key=str)
    assert len(got) == df.count()
    per = {}
    for r in plan.collect():
        assert 0 <= r.taken <= 2 * r.size
        t = per.setdefault(r.source, [r.target, 0, r.source_size, 0])
        t[1] += r.taken
        t[3] += r.size
    for source, (target, taken, size, total) in per.items():
        assert size == total and abs(taken - target) <= 8 * (2 + size / 2000), (source, target, taken)


def test_mixed_rows_carry_the_taken_words(spark):
    df = spark.createDataFrame(rows(), DOCS)
    out = mixing.mix(df, block=8, shard_words=2000)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    keyed, key = keyed_rows(df)  # rows without an id are dealt by their own key, and taken like any others
    want = {}
    for r in mixing.mix_plan(keyed, block=8, shard_words=2000, key_col=key).collect():
        if r.taken:
            want[r.id] = want.get(r.id, 0) + r.taken
    assert words == want and None in want
    texts = {}
    for r in rows():
        texts.setdefault(r[0], []).append(r[1] or "")
    assert all(any(r.text.strip() in t for t in texts[r.doc_id]) for r in out.collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix_plan(df).count() == 0 and mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, "", "a", "", ""), (2, None, None, "", "")], DOCS)
    assert [r.taken for r in mixing.mix_plan(blank).collect()] == [0, 0]
