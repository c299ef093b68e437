"""Search kernel vs brute force, scans on hand-made files, streaming = batch, plan checks."""

import json
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from conftest import SF
from tessera.operators.search import article_query_distances, nearest_articles
from tessera.sources import files as FS


def test_kernel_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    arts = [(i, rng.normal(size=(rng.integers(1, 6), 4)).round(3).astype(np.float32).tolist()) for i in range(40)]
    qs = [(q, t, rng.normal(size=4).round(3).astype(np.float32).tolist()) for q in range(3) for t in range(rng.integers(1, 4))]
    a = spark.createDataFrame(arts, "article_id long, vecs array<array<float>>")
    q = spark.createDataFrame(qs, "query_id long, tok_no long, vec array<float>")
    got = {(r["query_id"], r["article_id"]): r["distance"] for r in article_query_distances(a, q).collect()}
    for qid in range(3):
        Q = np.array([v for (qq, _, v) in qs if qq == qid], dtype=np.float64)
        for aid, vecs in arts:
            X = np.array(vecs, dtype=np.float64)
            d = np.mean([np.min(np.linalg.norm(qv - X, axis=1)) for qv in Q])
            assert abs(got[(qid, aid)] - d) < 1e-6
    top = nearest_articles(a, q, k=5).collect()
    assert len(top) == 15


def test_search_plan_keeps_articles_unshuffled(spark):
    from tessera.plans.search import search_vectors
    plan = search_vectors(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan or "PythonMapInArrow" in plan
    assert "WindowGroupLimit" in plan or "Window" in plan


def test_scan_article_json_edge_cases(spark):
    root = tempfile.mkdtemp(prefix="tessera-json-")
    os.makedirs(os.path.join(root, "sub"))
    docs = {
        "a.json": {"paper_id": "a", "metadata": {"title": "T", "authors": [
            {"first": "J", "middle": [], "last": "D"}, {"first": "X", "middle": ["Y", "Z"], "last": "W"},
            {"first": "M", "middle": "Q", "last": "N"}]},
            "abstract": [{"text": "abs"}], "body_text": [{"text": " b1 "}, {"text": "b2"}]},
        "sub/b.json": {"paper_id": "b", "metadata": {"title": "U", "authors": []}, "abstract": [{"text": "only"}]},
        "c.json": {"paper_id": "c", "metadata": {"title": "V", "authors": []}, "body_text": []},
    }
    for name, d in docs.items():
        with open(os.path.join(root, name), "w") as f:
            json.dump(d, f, indent=2)  # pretty-printed: one article per file
    with open(os.path.join(root, "notes.txt"), "w") as f:
        f.write("not json")
    from tessera.operators.articles import article_record
    rows = {r["paper_id"]: r for r in article_record(FS.scan_article_json(spark, root)).collect()}
    assert rows["a"]["authors"] == "J  D\nX Y Z W\nM Q N"
    assert rows["a"]["concat_text"] == "abs\n b1 \nb2".strip()
    assert rows["b"]["concat_text"] == "" and rows["b"]["full_abstract"] == "only"
    assert rows["c"]["concat_text"] == "" and rows["c"]["full_text"] == ""


def test_metadata_csv_null_rules_and_first_row(spark):
    root = tempfile.mkdtemp(prefix="tessera-csv-")
    path = os.path.join(root, "metadata.csv")
    with open(path, "w") as f:
        f.write('title,abstract,authors,doi,publish_time,extra\n'
                't1,A,"x\ny",d1,NA,e\n'          # first of group A has a null -> group vanishes
                't2,A,z,d2,2020,e\n'
                't3,B,"q ""w""",d3,2021,e\n'
                't4,,z,d4,2020,e\n'
                't5,nan,z,d5,2020,e\n')
    from tessera.operators.metadata import metadata_clean
    df = FS.scan_metadata_csv(spark, path)
    rows = metadata_clean(df).select(*FS.METADATA_COLUMNS).collect()
    assert [(r["title"], r["authors"]) for r in rows] == [("t3", 'q "w"')]


def test_pair_lines_ids_follow_file_order(spark):
    root = tempfile.mkdtemp(prefix="tessera-pairs-")
    path = os.path.join(root, "pairs.txt")
    with open(path, "w", newline="") as f:
        f.write("a ||| b\nc ||| d ||| e\n\nx\ry ||| z\nlast")
    rows = FS.scan_pair_lines(spark, path).orderBy("unique_id").collect()
    assert [(r["unique_id"], r["text_a"], r["text_b"]) for r in rows] == [
        (0, "a", "b"), (1, "c ||| d", "e"), (2, "", None), (3, "x\ry", "z"), (4, "last", None)]


def test_story_files_skip_summary_and_subfolders(spark):
    root = tempfile.mkdtemp(prefix="tessera-stories-")
    os.makedirs(os.path.join(root, "nested"))
    for name, text in {"s1.story": "a\r\nb\n@highlight\nc", "s1.summary": "x", "nested/s2.story": "y"}.items():
        with open(os.path.join(root, name), "w", newline="") as f:
            f.write(text)
    rows = FS.scan_story_files(spark, root).collect()
    assert [(r["document_name"], r["raw_story"]) for r in rows] == [("s1.story", "a\nb\n@highlight\nc")]


def test_stream_resume_equals_batch(spark):
    import __spark_entry__ as e
    batch = sorted(tuple(r) for r in e.queries()["search_vectors"](spark, SF).collect())
    stream = sorted(tuple(r) for r in e.queries()["stream_resume"](spark, SF).collect())
    assert batch == stream


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["query_id", "rank", "article_id", "distance"]
    assert df.count() > 0


def test_query_blocks_and_article_chunks_give_same_answer(spark, monkeypatch):
    import tessera.operators.search as S
    rng = np.random.default_rng(5)
    arts = [(i, rng.normal(size=(rng.integers(1, 5), 3)).round(2).astype(np.float32).tolist()) for i in range(30)]
    qs = [(q, t, rng.normal(size=3).round(2).astype(np.float32).tolist()) for q in range(7) for t in range(2)]
    a = spark.createDataFrame(arts, "article_id long, vecs array<array<float>>")
    q = spark.createDataFrame(qs, "query_id long, tok_no long, vec array<float>")
    one = sorted(tuple(r) for r in S.nearest_articles(a, q, k=4).collect())
    monkeypatch.setattr(S, "BATCH_CELLS", 3)      # a few articles per kernel call
    many = sorted(tuple(r) for r in S.nearest_articles(a, q, k=4, max_block_bytes=100).collect())
    assert one == many and len(one) == 28


def test_nan_component_and_fewer_than_k(spark):
    arts = [(1, [[0.0, 0.0]]), (2, [[float("nan"), 0.0], [1.0, 1.0]]), (3, [[0.5, 0.0]])]
    a = spark.createDataFrame(arts, "article_id long, vecs array<array<float>>")
    q = spark.createDataFrame([(7, 0, [0.0, 0.0])], "query_id long, tok_no long, vec array<float>")
    rows = nearest_articles(a, q, k=10).orderBy("rank").collect()
    assert [r["article_id"] for r in rows] == [1, 3, 2]  # NaN sorts last, as numpy's argmax evicts it first
    assert rows[2]["distance"] != rows[2]["distance"]
    assert [r["rank"] for r in rows] == [1, 2, 3]  # fewer than k articles: all kept


def test_fused_encoder_matches_given_vectors(spark, monkeypatch):
    """Token ids + encoder inside the kernel == vectors materialised first (both tile paths)."""
    import tessera.operators.search as S
    from tessera.plans import search as P
    enc = P.lookup_encoder(spark, SF)
    arts = P.text_articles(spark, SF)
    queries = P.query_vectors(P.text_queries(spark, SF), enc)
    with_vecs = P.embed_texts(arts, enc, "article_id")
    base = sorted(tuple(r) for r in S.nearest_articles(with_vecs, queries, k=5).collect())
    fused = sorted(tuple(r) for r in P.search_texts(arts, P.text_queries(spark, SF), enc, k=5).collect())
    monkeypatch.setattr(S, "BATCH_CELLS", 2000)  # distinct-vector matrix too big: per-token tiles
    small = sorted(tuple(r) for r in P.search_texts(arts, P.text_queries(spark, SF), enc, k=5).collect())
    assert base == fused == small


def test_long_form_minima_equal_nested_form(spark):
    """Article tokens spread over many partitions: partial minima + min aggregate == nested."""
    import tessera.operators.search as S
    from tessera.sources.derived import articles_from_long, vector_search_inputs
    art_long, queries = vector_search_inputs(spark, SF)
    nested = S.min_distance_per_query_token(articles_from_long(art_long), queries).drop("nearest_pos")
    long = S.min_distance_long(art_long.repartition(7), queries)
    blocks = S.min_distance_long(art_long, queries, max_block_bytes=2000)  # several query blocks
    want = sorted(tuple(r) for r in nested.collect())
    assert want == sorted(tuple(r) for r in long.select(*nested.columns).collect())
    assert want == sorted(tuple(r) for r in blocks.select(*nested.columns).collect())


def test_articles_to_parquet(spark):
    from tessera.session import scratch_path
    from tessera.sources.derived import write_article_json
    src = write_article_json(spark, SF, scratch_path(spark, "t-json"))
    out = FS.articles_to_parquet(spark, src, scratch_path(spark, "t-pq"), multi_line=False, glob="*.txt")
    df = spark.read.parquet(out)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {"paper_id", "concat_text", "title", "full_abstract", "authors", "full_text", "file_path"} == set(df.columns)
