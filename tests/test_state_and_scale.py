"""State that cannot vanish, whole texts, one model load per worker, exact arithmetic."""

import os
import shutil

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tessera.operators import embed as E
from tessera.operators import hypotheses as H
from tessera.operators import search as SR
from tessera.session import checkpoint_root, scratch_path
from tessera.sources import derived as D
from tessera.streaming import topk as STR


def _local(path):
    return path.replace("file:", "")


def _arrivals(spark, n=3):
    art_long, queries = D.vector_search_inputs(spark, SF)
    arts = D.articles_from_long(art_long).select("article_id", "vecs")
    src = scratch_path(spark, "t-src")
    arts.repartition(n).write.parquet(src)
    return arts, queries, src


def test_lost_or_unreadable_state_raises(spark):
    arts, queries, src = _arrivals(spark)
    state, ckpt = _local(scratch_path(spark, "t-state")), _local(scratch_path(spark, "t-ckpt"))
    STR.stream_topk(spark, src, queries, state, ckpt)
    arts.limit(1).write.mode("append").parquet(src)
    newest = max(int(d[2:]) for d in os.listdir(state) if d.startswith("v="))
    for f in os.listdir(f"{state}/v={newest}"):
        if f.endswith(".parquet"):
            with open(f"{state}/v={newest}/{f}", "wb") as out:
                out.write(b"not parquet")
    with pytest.raises(Exception):
        STR.stream_topk(spark, src, queries, state, ckpt).collect()
    with pytest.raises(RuntimeError):
        STR.stream_topk(spark, src, queries, scratch_path(spark, "t-other"), ckpt)


def test_half_written_version_is_ignored_and_old_ones_go(spark):
    _, queries, src = _arrivals(spark, 4)
    state, ckpt = _local(scratch_path(spark, "t-state")), _local(scratch_path(spark, "t-ckpt"))
    first = sorted(map(tuple, STR.stream_topk(spark, src, queries, state, ckpt, max_files_per_trigger=1).collect()))
    kept = sorted(int(d[2:]) for d in os.listdir(state) if d.startswith("v="))
    assert len(kept) == STR.KEPT_VERSIONS
    shutil.copytree(f"{state}/v={kept[-1]}", f"{state}/v=99", ignore=shutil.ignore_patterns("_SUCCESS", "*.crc"))
    assert max(STR._versions(spark, state)) == kept[-1]
    assert sorted(map(tuple, STR.stream_topk(spark, src, queries, state, ckpt).collect())) == first


def test_articles_in_subfolders_arrive(spark, tmp_path):
    for name in ("a.json", "sub/deep/b.json"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text('{"paper_id": "%s",\n "metadata": {"title": "t", "authors": []}, "abstract": [{"text": "x"}], "body_text": [{"text": "y"}]}' % name[-6])
    out = STR.stream_articles(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.paper_id for r in out.collect()) == ["a", "b"]


def test_word_500_decides_the_rank(spark):
    from tessera.plans.search import lookup_encoder, search_texts
    filler = " ".join(["same"] * 499)
    arts = spark.createDataFrame([(i, f"{filler} {w} {filler}") for i, w in enumerate(["alpha", "beta", "gamma"])], "article_id long, text string")
    queries = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "query_id long, text string")
    got = search_texts(arts, queries, lookup_encoder(spark, SF), k=1).collect()
    assert {r.query_id: r.article_id for r in got} == {1: 0, 2: 1, 3: 2}


@pytest.mark.parametrize("n", [0, 1, 125, 126, 127, 252, 300])
def test_windows_hold_every_word(spark, n):
    text = " \t".join(f"W{i}" for i in range(n))
    row = spark.createDataFrame([(text,)], "t string").select(E.word_tokens(F.col("t")).alias("k"), E.word_windows(F.col("t")).alias("w")).first()
    words = [f"w{i}" for i in range(n)]
    parts = [words[i:i + 126] for i in range(0, max(n, 1), 126)]
    assert row.k == [x for p in parts for x in ["[CLS]", *p, "[SEP]"]]
    assert [x.split() for x in row.w] == parts


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    def make(folder=str(tmp_path)):
        import os
        import uuid
        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda ids, mask, types: (ids + 10 * types)[:, :, None].astype("float32")

    df = spark.range(0, 60, 1, 12).select("id", F.array(F.col("id").cast("int"), F.lit(2)).alias("input_ids"),
                                          F.expr("array(1, 1)").alias("input_mask"), F.expr("array(0, 1)").alias("input_type_ids"))
    out = E.embed_model_inputs(df, E.BatchEncoder(make, batch_size=4, with_types=True)).collect()
    assert all(r.vecs == [[float(r.id)], [12.0]] for r in out)
    loads = os.listdir(tmp_path)
    assert len(loads) == len({x.split("-")[0] for x in loads})
    other = E.embed_model_inputs(df, E.BatchEncoder(lambda: lambda i, m, t: i[:, :, None] * 0.0, with_types=True)).first()
    assert other.vecs == [[0.0], [0.0]]


def test_near_matches_of_wide_vectors_are_exact():
    rng = np.random.default_rng(0)
    q = np.round(rng.normal(0, 10, (20, 768)) * 1e6)
    x = q.copy()
    x[:, 0] += 3
    g, rest = SR._partial_sq_dist(x, q)
    assert (np.diag(g + rest[None, :]) == 9).all()


def test_words_and_flat_index(spark):
    from tessera.functions.arrays import split_flat_index
    from tessera.functions.strings import words
    df = spark.createDataFrame([("  Alpha\tBeta\xa0gamma\r\ndelta ", 9007199254740993 * 7 + 3), ("", 5)], "t string, i long")
    beam, tok = split_flat_index(F.col("i"), 7)
    rows = df.select(words("t").alias("w"), beam.alias("b"), tok.alias("k")).collect()
    assert rows[0].w == ["alpha", "beta", "gamma", "delta"] and rows[1].w == []
    assert (rows[0].b, rows[0].k) == (9007199254740993, 3)


def test_every_document_keeps_a_hypothesis(spark):
    cands = [(1, 60, 0, 0, "[unused1]", 2, ["[unused0]", "a"], -1.0, -1.0), (1, 60, 1, 1, "b", 9, ["[unused0]", "a"], -0.1, -0.1),
             (2, 60, 0, 1, "c", 9, ["[unused0]", "a"], -1.0, -1.0), (3, 199, 0, 1, "d", 9, ["[unused0]", "a"], -1.0, -1.0)]
    df = spark.createDataFrame(cands, "doc_id long, step int, beam int, cand int, token string, token_id int, alive array<string>, beam_logprob double, token_logprob double")
    got = {r.doc_id: (r.cand, r.finished) for r in H.rerank_hypotheses(df).collect()}
    assert got == {1: (0, True), 2: (1, False), 3: (1, True)}


def _decoding_loop(rows, beam=3, least=2, most=7, alpha=0.95):
    """The decoder's loop over the candidates of one document, step by step."""
    kept = []
    for step in range(most):
        here = [r for r in rows if r["step"] == step]
        if not here:
            continue
        for r in here:
            lp = -1e20 if step < least and r["token"] == "[unused1]" else r["token_logprob"]
            r["score"] = (r["beam_logprob"] + lp) / ((5.0 + (step + 1)) / 6.0) ** alpha
        best = sorted(here, key=lambda r: (-r["score"], r["beam"], r["token_id"]))[:beam]
        done = [r["token"] == "[unused1]" or step + 1 == most for r in best]
        closed = done[0]
        kept += [r for r, d in zip(best, done) if d or closed]
        if closed:
            return max(kept, key=lambda r: r["score"]), True  # the first of equals
    return None, False


def test_first_closing_step_ends_a_document(spark):
    rnd = random.Random(4)
    table = []
    for doc in range(200):
        for step in range(rnd.randint(1, 7)):
            for beam in range(3):
                for cand in range(2):
                    token = rnd.choice(["[unused1]", "a", "b", "c"])
                    table.append((doc, step, beam, cand, token, 2 if token == "[unused1]" else 10 + cand + 2 * beam, ["[unused0]", f"w{beam}{cand}"],
                                  -rnd.randint(0, 6) / 4, -rnd.randint(0, 8) / 2))
    names = ["doc_id", "step", "beam", "cand", "token", "token_id", "alive", "beam_logprob", "token_logprob"]
    table = list({(r[0], r[1], r[2], r[5]): r for r in table}.values())  # a beam lists a token once
    df = spark.createDataFrame(table, "doc_id long, step int, beam int, cand int, token string, token_id int, alive array<string>, beam_logprob double, token_logprob double")
    got = {r.doc_id: r for r in H.rerank_hypotheses(df.repartition(5), beam_size=3, min_length=2, max_length=7).collect()}
    closed = 0
    for doc in range(200):
        best, end = _decoding_loop([dict(zip(names, r)) for r in table if r[0] == doc])
        if end:
            closed += 1
            assert got[doc].finished and (got[doc].beam, got[doc].cand) == (best["beam"], best["cand"])
            assert abs(got[doc].score - best["score"]) < 1e-9 * max(1, abs(best["score"]))
    assert 50 < closed < 200 and len(got) == 200


def test_no_window_by_label_over_vectors(spark):
    art_long, queries = D.vector_search_inputs(spark, SF)
    plan = art_long._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window ["):]
    assert "embedding" not in below[:below.index("Relation")]  # only ids and labels are numbered
    assert art_long.count() + queries.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_unset_folder_is_an_error_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        checkpoint_root(Session())


def test_flagship_is_the_same_without_a_broadcast_table(spark, monkeypatch):
    from tessera.plans import search as P
    want = sorted(map(tuple, P.search_articles(spark, SF).collect()))
    monkeypatch.setattr(E.LookupEncoder.__init__, "__defaults__", ("embedding", "vec_id", 1))
    enc = P.lookup_encoder(spark, SF)
    assert not enc.fits
    assert sorted(map(tuple, P.search_articles(spark, SF).collect())) == want


def test_joined_vectors_equal_gathered_ones(spark):
    from tessera.plans import search as P
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["c"])], "k long, tokens array<string>")
    got = [{r.k: r.vecs for r in E.embed_tokens(df, E.LookupEncoder(table, max_bytes=b)).collect()} for b in (1, 1 << 28)]
    assert got[0] == got[1] and len(got[0][1]) == 3 and got[0][2] == []
    assert P.K == 10


def test_vocabulary_gives_the_same_ids_at_every_size(spark):
    from tessera.operators.tokens import Vocabulary, ids_to_tokens, tokens_to_ids
    words = spark.createDataFrame([(w,) for w in ["b", "a", "é", "z"]], "token string")
    df = spark.createDataFrame([(1, ["z", "nope", "a"]), (2, [])], "k long, tokens array<string>")
    for bound in (2, 100):
        vocab = Vocabulary.from_words(words, ["[PAD]", "[UNK]"], max_entries=bound)
        ided = tokens_to_ids(df, vocab)
        assert {r.k: r.input_ids for r in ided.collect()} == {1: [4, 1, 2], 2: []}
        assert {r.k: r.back for r in ids_to_tokens(ided, vocab, "input_ids", "back").collect()} == {1: ["z", "[UNK]", "a"], 2: []}


def test_malformed_articles_are_never_silent(spark, tmp_path):
    from tessera.sources.files import scan_article_json
    (tmp_path / "bad.json").write_text('{"paper_id": "x", "abstract": [')
    (tmp_path / "good.json").write_text('{"paper_id": "y"}')
    with pytest.raises(Exception):
        scan_article_json(spark, str(tmp_path)).collect()
    rows = scan_article_json(spark, str(tmp_path), mode="PERMISSIVE").cache().collect()
    assert {r.document_name: r._corrupt_record is not None for r in rows} == {"bad.json": True, "good.json": False}


def test_scratch_is_discarded(spark):
    from tessera.session import discard_scratch
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(_local(path))
    kept = _local(path)
    from tessera import session
    session._SCRATCH[:] = [path]
    assert discard_scratch(spark) == 1 and not os.path.exists(kept)
