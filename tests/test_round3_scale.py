"""Findings of round 3 on time, disk and memory: rows as before, by steps that stay bounded."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F


def test_blocks_of_aligned_documents_are_read_a_few_at_a_time(spark):
    from tessera.llm import cross_tokenizer as X
    from tessera.llm.common import tokenizer_path
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    text = "some words " * (X.BLOCK_CHARS // 11 + 1)  # a block of its own
    docs = spark.createDataFrame([(i, text) for i in range(X.BLOCKS_AT_ONCE + 2)], "doc_id long, text string").coalesce(1)
    blocks = X._blocks_written(docs, *paths, "doc_id", "text")
    assert blocks.count() == X.BLOCKS_AT_ONCE + 2
    [file] = blocks.inputFiles()
    found = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert [found.row_group(i).num_rows for i in range(found.num_row_groups)] == [X.BLOCKS_AT_ONCE, 2]


def test_units_are_forgotten_by_their_bytes_too(monkeypatch):
    from tessera.llm import cross_tokenizer as X
    from tessera.llm.common import ModelFile, tokenizer_path
    data = [ModelFile(tokenizer_path(n)).data for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    texts = [f"word{i} and many others {'x' * i}" for i in range(50)]
    kept, bounded = X.TokenizerPair(*data), X.TokenizerPair(*data)
    want = [X.Block(kept, [t]).digests() for t in texts]
    monkeypatch.setattr(X, "UNIT_BYTES", 1000)
    assert [X.Block(bounded, [t]).digests() for t in texts] == want
    assert bounded.group_bytes + bounded.links.nbytes < 2000 < kept.group_bytes + kept.links.nbytes


def _two_tasks(spark, fail_after):
    """Rows 0 and 1 in tasks of their own; the second fails when the first has long ended."""
    def run(batches):
        import time
        for batch in batches:
            if batch.column(0)[0].as_py() == 1:
                time.sleep(fail_after)
                raise ValueError("stopped")
            yield batch
    return spark.range(0, 2, 1, 2).select("id", F.lit("{}").alias("value")).mapInArrow(run, "id long, value string")


def test_article_files_are_put_in_place_by_their_tasks(spark, tmp_path, monkeypatch):
    from tessera.plans import text_queries as Q
    monkeypatch.setattr(Q.D, "article_json_lines", lambda *_: _two_tasks(spark, 6))
    monkeypatch.setattr(Q, "scratch_path", lambda *_: str(tmp_path / "files"))
    with pytest.raises(Exception, match="stopped"):
        Q.scan_article_files(spark, "")
    assert len(glob.glob(f"{tmp_path}/files/corpus/part/*.txt")) == 1  # the driver moved nothing


def test_story_files_are_put_in_place_by_their_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter
    from tessera.sources import derived as D
    from tessera.sources.files import MANY_FILES, scan_story_files
    given, options = [], DataFrameWriter.options
    monkeypatch.setattr(DataFrameWriter, "options", lambda self, **kw: (given.append(kw), options(self, **kw))[1])
    monkeypatch.setattr(D, "raw_stories", lambda spark, _: spark.createDataFrame([(1, "a\nb"), (22, "c")], "conv_id long, raw_story string"))
    path = D.write_story_files(spark, "", str(tmp_path / "stories"))
    assert MANY_FILES in given
    found = scan_story_files(spark, path, partitioned=True).select("conv_id", "raw_story").collect()
    assert sorted(map(tuple, found)) == [(1, "a\nb\n"), (22, "c\n")]


def test_padding_is_not_shuffled_to_one_task(spark):
    from tessera.operators import tokens as TK
    table = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), *[(f"w{i}", i) for i in range(2, 400)]], "token string, id int")
    vocab = TK.Vocabulary(table, max_entries=0)
    rows = [(i, [2 + (i * 7 + j) % 398 for j in range(i % 20)] + [0] * 100) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, ids array<int>").repartition(8)
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        out = TK.ids_to_tokens(df, vocab, "ids", "back")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.k: r.back for r in out.collect()}
    finally:
        for k in off:
            spark.conf.unset(k)
    name = {0: "[PAD]", **{i: f"w{i}" for i in range(2, 400)}}
    assert got == {k: [name[i] for i in ids] for k, ids in rows}
    assert "BroadcastHashJoin" in plan  # the padding meets its entry where it is read


def test_count_of_frequent_keys_is_shuffled_once(spark):
    from tessera.operators import skew
    df = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("t"))
    assert skew.heavy_hitters(df, "t") == ["a"]  # a third is null, a third is all different
    assert skew.heavy_hitters(df.filter("t is null"), "t") == []


def test_rerank_shuffles_once_and_no_sequences(spark):
    from tessera.operators import hypotheses as H
    rows = [(d, s, b, c, tok, b, ["[unused0]", *"abcdefgh"[:s]], -float(b + c), -0.5)
            for d in range(6) for s in range(1, 5) for b in range(3) for c, tok in enumerate(("x", "[unused1]"))]
    df = spark.createDataFrame(rows, "doc_id long, step int, beam int, cand int, token string, token_id int, alive array<string>, "
                                     "beam_logprob double, token_logprob double")
    out = H.rerank_hypotheses(df, min_length=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(doc_id" in exchanges[0]
    best = {r.doc_id: (r.beam, r.cand, r.finished, r.text) for r in out.collect()}
    assert best == dict.fromkeys(range(6), (0, 1, True, "a b c d [unused1]"))


def _model(dim):
    def make():
        table = np.random.default_rng(3).normal(size=(500, dim)).astype(np.float32).round(6)
        return lambda ids, mask, types: table[ids + types]
    return make


def test_model_search_sends_each_tasks_best_only(spark):
    import random

    from tessera.operators import embed as E
    from tessera.operators import search as SR
    rnd, dim = random.Random(5), 4
    rows = []
    for i in range(300):
        for _ in range(rnd.randint(1, 4)):  # windows, some of the same article far from each other
            n = rnd.randint(1, 6)
            rows.append((i % 250, [rnd.randint(0, 60) for _ in range(n)] + [0] * (6 - n), [1] * n + [0] * (6 - n), [0] * 6))
    inputs = spark.createDataFrame(rows, "article_id long, input_ids array<int>, input_mask array<int>, input_type_ids array<int>").repartition(5)
    table = _model(dim)()(np.arange(500), None, np.zeros(500, int))
    queries = spark.createDataFrame([(q, t, table[rnd.randint(0, 80)].tolist()) for q in range(7) for t in range(1 + q % 3)],
                                    "query_id long, tok_no long, vec array<float>")
    model = E.BatchEncoder(_model(dim), batch_size=4, with_types=True)
    whole = SR.min_distance_model(inputs, queries, model)
    best = SR.min_distance_model(inputs, queries, model, k=3)
    top = lambda minima: sorted(map(tuple, SR.topk_closest(SR.mean_best_distance(minima), 3).collect()))
    assert top(best) == top(whole)
    assert set(best.collect()) < set(whole.collect())
    blocks = SR.min_distance_model(inputs, queries, model, k=3, max_block_bytes=200)  # several passes
    assert top(blocks) == top(whole)
    assert SR.min_distance_model(inputs.limit(0), queries, model, k=3).count() == 0


def test_best_minima_hold_ties_and_open_articles():
    from tessera.operators.search import _BestMinima, _distinct_vectors, _run_minima
    payload = {"Qu": np.array([[0.0], [5.0]]), "inv": np.array([0, 1, 0]), "starts": np.array([0, 2]), "counts": np.array([2, 1]),
               "query_ids": np.array([10, 11]), "tok_query": np.array([10, 10, 11]), "tok_no": np.array([0, 1, 0])}
    best = _BestMinima(payload, 2)
    for arts, minima in (([1, 2], [[4.0, 9], [1, 1]]), ([2, 3], [[0.0, 4], [0, 1]]), ([4], [[0.0, 1]])):
        best.add(np.array(arts), np.array(minima))
    best.add(np.empty(0, np.int64), np.empty((0, 2)), last=True)
    pairs = {(r["query_id"], r["article_id"]) for r in best.minima().to_pylist()}
    assert pairs == {(10, 4), (10, 3), (11, 4), (11, 3)}  # 2, 3 and 4 are equal: the later stay
    V = np.array([[1.5], [0.25], [1.5], [-0.0], [0.0]], np.float32)
    X, row_of = _distinct_vectors(V)
    assert X[row_of].tolist() == V.tolist() and len(X) == 4
    arts, minima = _run_minima(np.array([7, 7, 8, 8, 8]), V, np.array([[0.0], [1e6]]))
    assert arts.tolist() == [7, 8] and minima.tolist() == [[0.0625e12, 0.25e12], [0.0, 0.25e12]]


def test_vectors_are_folded_in_slices_where_they_are_made(spark, monkeypatch):
    import pyarrow as pa

    from conftest import SF
    from tessera.plans import model_queries as Q
    monkeypatch.setattr(Q, "CHECKSUM_BYTES", 1000)
    vecs = [[[float(i), 1.0]] * (i % 5) for i in range(100)]
    batch = pa.record_batch([pa.array(range(100), pa.int64()), pa.array(vecs, pa.list_(pa.list_(pa.float32())))], ["k", "vecs"])
    fold, _ = Q._checksum_fold("k")
    parts = list(fold([batch]))
    assert len(parts) > 3
    got = [r for p in parts for r in p.to_pylist()]
    assert got == [{"k": i, "n_tokens": i % 5, Q.VEC_SUM: sum((p + 1) * (i + 1) * 10 ** 6 for p in range(i % 5))} for i in range(100)]
    for query in (Q.embed_tokens, Q.micro_batch):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
