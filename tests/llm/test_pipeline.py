import hashlib

import sentencepiece
from conftest import SF
from test_simhash import brute_fp, brute_groups

import corpus_pipeline
from tessera.llm import mixing, quality
from tessera.llm.common import tokenizer_path


def brute_rest(texts, length=100):
    """What remains of texts (in the order of their ids) without repeated byte strings."""
    seen, out = set(), []
    for text in texts:
        data = text.encode()
        hit = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s:s + length]
            if w in seen:
                hit[s:s + length] = b"\x01" * length
            seen.add(w)
        out.append(bytes(c for c, x in zip(data, hit) if not x).decode("utf-8", "ignore"))
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns, name
        rows[k] = docs.collect()
    given = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    base = {i for i, r in given.items() if (m := quality.measure(r.text.encode()))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    good = {r.doc_id: r for r in rows[0]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(good) <= base and sum(labels.get(i) == 1 for i in base - set(good)) <= 0.05 * len(base)
    groups = brute_groups({i: brute_fp(r.text) for i, r in good.items()})
    assert sorted(r.doc_id for r in rows[1]) == sorted(set(groups.values()))
    apart = sorted(rows[1], key=lambda r: r.doc_id)
    left = {r.doc_id: r for r in rows[2]}
    assert [left[r.doc_id].text for r in apart] == brute_rest([r.text for r in apart])
    assert all(r.n_chars == len(r.text) for r in rows[2] + rows[3])
    plan = {r.id: r for r in mixing.mix_plan(spark.read.parquet(f"{tmp_path}/2")).collect()}
    taken = {}
    for r in rows[3]:
        assert r.text in left[r.doc_id].text
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.encode().split())
    assert taken == {i: p.taken for i, p in plan.items() if p.taken}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = []
    for r in rows[3]:
        ids = library.encode(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, rows[4])) == sorted(want)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


def _prose(n, start=0):
    return " ".join(f"w{(start + 7 * i * i) % 9973}" for i in range(n))


def _odd_docs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b, c, d = _prose(60), _prose(70, 3), _prose(50, 11), _prose(80, 29)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(3, a, "en", "s", 0), (5, a, "en", "s", 0), (5, b, "en", "s", 0), (None, c, "en", None, 0), (None, "", "en", None, 0),
            (None, d, None, "t", 0), (6, d, "en", "t", 0), (8, None, None, None, None), (8, "x y", "en", "s", 0),
            (9, _prose(30, 41) + passage, "en", "s", 0), (9, _prose(35, 57) + passage, "en", "s", 0),
            (10, _prose(90, 5), "en", "s", 0), (10, _prose(90, 5), "en", "s", 0)]
    return spark.createDataFrame(rows, docs.schema), rows


def test_rows_of_null_and_shared_ids(spark):
    docs, rows = _odd_docs(spark)
    texts = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
    pairs = lambda some: sorted((i is None, i or 0, t or "") for i, t, *_ in some)
    # quality: a row goes by its own text
    long = [r for r in rows if r[1] and len(r[1].split()) >= 20]
    assert texts(corpus_pipeline.quality_rules(spark, docs, SF)) == pairs(long)
    # near copies: one row of a group, the smallest id before a null one; nothing else goes
    want = [r for k, r in enumerate(rows) if k not in (1, 5, 12) and r[1]] + [(8, None)]  # null and "" are one group
    assert texts(corpus_pipeline.simhash_near_dedup(spark, docs, SF)) == pairs(want)
    # passages: each row its own remainder
    rest = [(i, t) for i, t in zip([r[0] for r in rows], brute_rest_of(rows))]
    assert texts(corpus_pipeline.suffix_array_dedup(spark, docs, SF)) == pairs(rest)
    # mixing: what the plan takes of every row
    plan = mixing.mix_plan(docs).collect()
    mixed = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == sum(p.taken for p in plan)
    assert any(r.doc_id is None for r in mixed) and all(any(r.text in (t or "") for i, t, *_ in rows if i == r.doc_id) for r in mixed)
    # ids: one row each
    assert corpus_pipeline.sentencepiece_ids(spark, docs, SF).count() == len(rows)


def brute_rest_of(rows):
    """Remainders in the order of ids (null last, then as given), returned in the given order."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    rest = brute_rest([rows[k][1] or "" for k in order])
    return [t for _, t in sorted(zip(order, rest))]


def test_stages_take_odd_tables(spark):
    docs, _ = _odd_docs(spark)
    blank = docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None), (None, "", "en", None, 0), (1, None, None, None, None)], docs.schema))
    counts = {}
    for name, table in (("empty", docs.limit(0)), ("blank", blank)):
        counts[name] = [stage(spark, table, SF).count() for _, stage in corpus_pipeline.STAGES]
    # blank texts fail the base rules, are one group of near copies, have nothing to remove and nothing to take
    assert counts == {"empty": [0] * 5, "blank": [0, 1, 3, 0, 3]}
