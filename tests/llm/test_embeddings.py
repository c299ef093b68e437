import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import embedding_dedup

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                     T.StructField("label", T.IntegerType()), T.StructField("component", T.StringType()), T.StructField("rep", T.StringType())])


def brute(rows, threshold=0.98):
    ids = [r[0] for r in rows]
    unit = []
    for r in rows:
        v = r[1]
        bad = v is None or r[2] is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v)
        unit.append(None if bad else np.array(v, np.float32).astype(np.float64) / np.linalg.norm(np.array(v, np.float32).astype(np.float64)))
    links = {i: set() for i in ids}
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]):
                if unit[a] @ unit[b] >= threshold:
                    links[ids[a]].add(ids[b])
                    links[ids[b]].add(ids[a])
    comp = {}
    for i in sorted(ids):
        if i in comp:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += links[x]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in ids}


def corpus():
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist(), int(i % 3), "c", "c") for i in range(300)]
    centre = rng.standard_normal(16)
    for i in range(300, 520):  # one dense group and some small ones
        base = centre if i < 460 else np.array(rows[i - 460][1])
        rows.append((i, (base + rng.standard_normal(16) * 0.08 * np.linalg.norm(base) / 4).tolist(), 1 if i < 460 else rows[i - 460][2], "c", "c"))
    rows += [(600 + i, rows[7][1], rows[7][2], "c", "c") for i in range(40)]
    rows += [(700, None, 1, "", ""), (701, [0.0] * 16, 1, "", ""), (702, [float("nan")] * 16, 1, "", ""), (703, [None] + [1.0] * 15, 1, "", ""),
             (704, rows[7][1], None, "", ""), (705, [float("inf")] * 16, 1, "", ""), (706, rows[7][1][:8], rows[7][2], "", ""), (707, [], 1, "", ""),
             (708, [3e38] * 16, 2, "", ""), (709, [1e-38] * 16, 2, "", "")]
    return rows


@pytest.mark.parametrize("small", [4, 1024])
def test_equal_to_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    rows = corpus()
    got = {r.id: (r.n_links, r.component, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()}
    want = brute(rows)
    links = sum(n for n, *_ in want.values())
    found = sum(min(got[i][0], want[i][0]) for i in want)
    assert found >= 0.9 * links and all(got[i][0] <= want[i][0] for i in want)
    assert got == want


@pytest.mark.parametrize("small,part", [(1024, 8192), (3, 40)])
def test_passes_over_labels_larger_than_their_windows(spark, monkeypatch, small, part):
    """Windows of 16: labels of about 100 to 260 vectors, one a dense group, take several passes."""
    monkeypatch.setattr(embedding_dedup, "WINDOW", 16)
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    monkeypatch.setattr(embedding_dedup, "PART_ROWS", part)
    rows = corpus()
    got = {r.id: (r.n_links, r.component, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()}
    want = brute(rows)
    assert sum(got[i][0] for i in want) >= 0.9 * sum(n for n, *_ in want.values())
    links = {r[0]: r for r in rows}
    for i, (n, component, kept) in got.items():  # nothing that is no link, and components that hang together
        assert n <= want[i][0] and component >= want[i][1] and kept == (component == i)
        assert links[component][2] == links[i][2]


def test_recall_in_a_label_of_many_windows(spark, monkeypatch):
    """20,000 vectors of mutual cosine 0.95 with 1,000 closer pairs, windows of 512."""
    monkeypatch.setattr(embedding_dedup, "WINDOW", 512)
    rng = np.random.default_rng(12)
    centre = rng.standard_normal(64)
    centre *= np.sqrt(0.95) / np.linalg.norm(centre)
    m = centre + rng.standard_normal((20_000, 64)) * np.sqrt(0.05 / 64)
    m[19_000:] = m[:1000] + rng.standard_normal((1000, 64)) * np.sqrt(0.02 / 64)
    m = m.astype(np.float32)
    unit = m.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = sum(int((unit[a:a + 2000] @ unit.T >= 0.98).sum()) for a in range(0, 20_000, 2000)) - 20_000
    df = spark.createDataFrame([(i, v.tolist(), 1, "c", "c") for i, v in enumerate(m)], ROWS).repartition(4)
    got = embedding_dedup.near_duplicates(df).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * want <= got <= want


def test_odd_rows(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0
    v = [1.0, 2.0]
    rows = [(1, v, 1, "", ""), (1, v, 1, "", ""), (None, v, 1, "", ""), (2, v, 1, "", "")]
    got = sorted(map(tuple, embedding_dedup.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False)]


def test_dense_topic_in_a_large_label_keeps_all_links(spark):
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(64)
    centre *= np.sqrt(0.95) / np.linalg.norm(centre)
    m = centre + rng.standard_normal((3000, 64)) * np.sqrt(0.05 / 64)
    m[2700:] = m[:300] + rng.standard_normal((300, 64)) * np.sqrt(0.03 / 64)  # pairs closer than the topic
    m = m.astype(np.float32)
    unit = m.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    assert near.sum() > 3000
    rows = [(i, v.tolist(), 1, "c", "c") for i, v in enumerate(m)]
    got = {r.id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {i: int(x) for i, x in enumerate(near.sum(axis=1) - 1)}
