"""Round 4: vectors that stay in the task that makes them, searches that score few pairs."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF
from tessera.operators import embed as E
from tessera.plans import model_queries as MQ


def _lookup(spark, n=23, dim=4):
    rng = random.Random(6)
    table = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(dim)]) for i in range(n)], "vec_id long, embedding array<float>")
    return E.LookupEncoder(table)


def test_vectors_by_token_stay_in_their_task(spark):
    for query in (MQ.vectors_by_token, MQ.flatten_vectors):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        plan = plan.partition("Initial Plan")[0]
        assert plan.count("MapInArrow") == 1 and "Generate" not in plan


def test_steps_in_a_task_give_the_rows_of_the_operators(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, [rng.choice("abcdéfg") for _ in range(rng.randint(0, 40))]]))
            for _ in range(80)]
    texts = spark.createDataFrame(rows, "article_id long, tokens array<string>").repartition(5)
    enc = _lookup(spark)
    monkeypatch.setattr(E, "IN_TASK_BYTES", 300)
    plain = E.vectors_by_token(E.token_vectors_long(E.embed_tokens(texts, enc)))
    made = E.token_vectors_long(E.embed_tokens(E.gathered(texts, "article_id"), enc, in_task=True))
    by = E.vectors_by_token(made, in_runs=True)
    ordered = lambda df: sorted(map(str, df.collect()))
    assert by.rows().columns == plain.columns and ordered(by.rows()) == ordered(plain)
    maps = E.token_vector_map(by, in_runs=True).rows()
    assert ordered(maps) == ordered(E.token_vector_map(plain))


def test_tokens_hashed_once_get_the_rows_of_the_expression(spark):
    tokens = ["[CLS]", "a", "é", "", "a", "漢字", "x" * 300]
    want = spark.range(1).select(E.lookup_token_ids(F.array(*map(F.lit, tokens)), 1009)).first()[0]
    assert E.hashed_rows(pa.array(tokens), 1009).tolist() == want


def test_flat_list_of_sliced_maps():
    maps = pa.array([[("a", [[1.0], [2.0]])], [("b", [[3.0]]), ("a", [[4.0]])], []], pa.map_(pa.string(), pa.list_(pa.list_(pa.float64()))))
    assert E.flatten_vectors(maps.slice(1)).to_pylist() == [[[3.0], [4.0]], []]


def test_rounding_in_numpy_is_that_of_the_expression(spark):
    values = np.array([0.0078125, -0.0078125, 1e-7, 5e-7, -0.3, 123.4567891, 0.5], np.float32)
    df = spark.createDataFrame([(values.tolist(),)], "v array<float>")
    assert E._rounded(values).tolist() == df.select(E.round_vector("v")).first()[0]


def test_one_file_per_row_is_written_by_the_task_itself(spark, tmp_path, monkeypatch):
    import glob

    from pyspark.sql.readwriter import DataFrameWriter
    from tessera.sources import files as FS
    monkeypatch.setattr(DataFrameWriter, "text", None)  # Spark's writer starts processes for every local file
    path = str(tmp_path / "a" / "files")
    rows = spark.createDataFrame([(t,) for t in ["{}", "é\nb", "", None, "{}"]], "value string").repartition(2)
    FS.write_one_per_file(rows, "value", path)
    found = [open(f, "rb").read() for f in glob.glob(f"{path}/*")]
    assert sorted(found) == sorted([b"{}\n", "é\nb\n".encode(), b"\n", b"\n", b"{}\n"])
    got = FS.scan_story_files(spark, path).select("raw_story").collect()
    assert sorted(r[0] for r in got) == ["\n", "\n", "{}\n", "{}\n", "é\nb\n"]


def test_small_files_are_read_in_few_tasks(spark, tmp_path):
    from tessera.sources import files as FS
    FS.write_one_per_file(spark.range(300).select(F.concat(F.lit('{"paper_id": "'), "id", F.lit('"}')).alias("value")), "value", str(tmp_path / "f"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # one file a split
    try:
        scanned = FS.scan_article_json(spark, str(tmp_path), glob="*.txt")
        assert scanned.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(int(r["paper_id"]) for r in scanned.collect()) == list(range(300))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _payload(rng, X, queries=8, tokens=3, far=1e3):
    n = queries * tokens
    Q = X[rng.integers(0, len(X), n)] + np.round(rng.normal(0, far, (n, X.shape[1])))
    return {"Q": Q, "Qu": Q, "inv": np.arange(n), "starts": np.arange(0, n, tokens), "counts": np.full(queries, tokens),
            "dim": X.shape[1], "query_ids": np.arange(queries), "tok_query": np.repeat(np.arange(queries), tokens),
            "tok_no": np.tile(np.arange(tokens), queries)}


def _best(payload, X, row_of, counts, parts=1, **kw):
    from tessera.operators import pruning
    from tessera.operators import search as SR
    best = pruning.RunningTopK(payload, 4, 1000, 10 ** 6, SR._partial_sq_dist, SR.MICRO, SR.PICO, minima=True)
    stops = np.append(0, np.cumsum(counts))
    for part in np.array_split(np.arange(len(counts)), parts):
        best.add(part, X, row_of[stops[part[0]]:stops[part[-1] + 1]], counts[part], **kw)
    return best


def test_near_rows_bound_and_find_all_minima(monkeypatch):
    from tessera.operators import pruning
    from tessera.operators import search as SR
    rng = np.random.default_rng(11)
    X = np.round(rng.normal(0, 1, (400, 16)) * 1e6)
    X[50:80] = X[20]  # equal vectors
    payload = _payload(rng, X, far=3e5)
    for most in (pruning.PAIRS, 600):  # radii shrink where more pairs would be kept
        monkeypatch.setattr(pruning, "PAIRS", most)
        monkeypatch.setattr(pruning, "BLOCK", 24 * 50)
        index = pruning.NearRows(payload["Qu"])
        index.grow(X[:150], 20)
        index.grow(X[150:], 20)
        assert len(index.column) <= most
        counts = rng.integers(1, 40, 200)
        row_of = rng.integers(0, 400, int(counts.sum()))
        G, rest = SR._partial_sq_dist(X[row_of], payload["Qu"])
        want = np.minimum.reduceat(G + rest, np.cumsum(counts) - counts, axis=0)
        assert (index.minima(row_of, counts).astype(float) * (1 - 2e-7) <= np.sqrt(want) + 1).all()
        got = np.array([index.nearest(r, X) for r in np.split(row_of, np.cumsum(counts)[:-1])])
        found = np.isfinite(got)
        assert (got[found] == want[found]).all() and found.mean() > (0.6 if most > 600 else 0.0)


def test_shared_vectors_are_scored_by_few_pairs_with_equal_results(monkeypatch):
    from tessera.operators import search as SR
    rng = np.random.default_rng(5)
    for scale in (1, 30):  # squares beyond 2 ** 53: only bounds come from the index
        X = np.round(rng.normal(0, 1, (500, 8)) * 1e6 * scale)
        payload = _payload(rng, X)
        counts = rng.integers(1, 30, 900)
        row_of = rng.integers(0, 500, int(counts.sum()))
        shared = _best(payload, X, row_of, counts, parts=3)
        plain = _best(payload, X[row_of], np.arange(len(row_of)), counts)
        assert (shared.ids == plain.ids).all() and (shared.dist == plain.dist).all() and shared.real.all()
        assert shared.minima().equals(plain.minima()) and shared.scored < shared.seen / 10
        for q in range(8):  # the distances sent are those of the pairs
            assert (shared.parts[q].sum(axis=1) / 3 / SR.PICO == shared.dist[q]).all()


def test_a_worker_remembers_vectors_by_their_bits():
    from tessera.operators import search as SR
    rng = np.random.default_rng(2)
    V = rng.normal(0, 1, (50, 4)).astype(np.float32)
    met = SR._MetVectors({"Qu": np.zeros((3, 4)), "dim": 4})
    first = met.rows_of(V[[3, 1, 3, 7]], 2)
    again = met.rows_of(V[[7, 9, 1, 3]], 2)
    assert first.tolist()[0] == first.tolist()[2] == again.tolist()[3] and again.tolist()[0] == first.tolist()[3]
    assert len(met) == 4 and (met[again] == SR._to_micro(V[[7, 9, 1, 3]])).all()
    assert (met[met.rows_of(V, 5)] == SR._to_micro(V)).all() and len(met) == 50


def test_groups_of_vectors_hold_whole_articles():
    from tessera.operators import search as SR
    arts = np.repeat([1, 2, 3, 4], [3, 9, 2, 1])
    V = np.arange(15, dtype=np.float32)[:, None] % 4
    pairs = [(arts[s:s + 2], V[s:s + 2]) for s in range(0, 15, 2)]
    groups = list(SR._vector_groups(pairs, 4))
    assert len(groups) > 1 and sum(([*dict.fromkeys(a.tolist())] for a, _ in groups), []) == [1, 2, 3, 4]
    got = {int(i): set(v[a == i].ravel().tolist()) for a, v in groups for i in set(a)}
    assert got == {i: set(V[arts == i].ravel().tolist()) for i in (1, 2, 3, 4)}


def test_few_arriving_files_are_dealt_to_all_task_slots(spark, tmp_path):
    from tessera.operators import search as SR
    from tessera.streaming import topk as ST
    rng = np.random.default_rng(3)
    arts = [(i, rng.normal(0, 1, (3, 4)).round(3).tolist()) for i in range(60)]
    df = spark.createDataFrame(arts, "article_id long, vecs array<array<float>>")
    queries = spark.createDataFrame([(q, t, rng.normal(0, 1, 4).round(3).tolist()) for q in range(3) for t in range(2)],
                                    "query_id long, tok_no long, vec array<float>")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    tasks = spark.sparkContext.accumulator(0)
    kernel = ST.topk_kernel

    def counted(bc, k, gather=None):
        run = kernel(bc, k, gather)

        def body(batches):
            batches = list(batches)
            tasks.add(any(b.num_rows for b in batches))
            yield from run(batches)
        return body
    ST.topk_kernel = counted
    try:
        got = ST.stream_topk_keyed(spark, str(tmp_path / "in"), queries, str(tmp_path / "ck"), k=5, max_files_per_trigger=1).collect()
    finally:
        ST.topk_kernel = kernel
    want = SR.nearest_articles(df, queries, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert tasks.value > 4 or spark.sparkContext.defaultParallelism <= 1
