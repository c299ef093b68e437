import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import cross_tokenizer
from tessera.llm.common import tokenizer_path

from test_tokens import odd_texts  # noqa: E402  (pytest puts this folder on the path)

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("block", T.StringType()), T.StructField("n_a", T.StringType())])


def brute_force(texts):
    """Whole texts by both libraries; groups and links by comparing byte ranges pair by pair."""
    import base64

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        bytes_a = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}

    def bytes_b(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(parts):
        ends = np.cumsum([len(x) for x in parts]).tolist()
        return list(zip([0, *ends[:-1]], ends))

    rows, links, count = [], [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = a_lib.encode(whole.decode(), add_special_tokens=False).ids, b_lib.encode(text or "")
        at_a, at_b = spans([bytes_a[i] for i in a]), spans([bytes_b(i) for i in b])
        if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(map(bytes_b, b)) != whole:
            a, b, at_a, at_b = [], [], [], []
        cuts = sorted({y for _, y in at_a} & {y for _, y in at_b})
        groups = [tuple([i for i, (x, y) in zip(ids, at) if lo <= x and y <= hi] for ids, at in ((a, at_a), (b, at_b)))
                  for lo, hi in zip([0, *cuts], cuts)]
        mine = [(i, j) for i, (x, y) in zip(a, at_a) for j, (u, v) in zip(b, at_b) if max(x, u) < min(y, v)]
        digest = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        rows.append((len(a), len(b), len(groups), len(mine), hashlib.sha256(digest.encode()).hexdigest() if a else ""))
        links.append(mine)
        count.update(mine)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(*r[:4], sum(count[p] == most[p[1]] for p in mine), sum(count[p] for p in mine), r[4])
            for r, mine in zip(rows, links)]


def test_equal_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cross_tokenizer, "BLOCK_CHARS", 2000)
    texts = [t[:400] if t and len(t) > 1000 else t for t in odd_texts()[::3]]
    texts += [None, "", "the cat's hat\r\n\r\n the\r\r();\r\n cat", "a\tb \x1c\x85\xa0 c　d\r", "\n\nx  y \n z ", "unbelievable▁x"]
    texts += [texts[20]] * 3  # repeated rows count each time
    ids = [None if i % 50 == 7 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], DOCS).repartition(3)
    got = cross_tokenizer.align(df, A, B).collect()
    want = sorted((str(i), *r) for i, r in zip(ids, brute_force(texts)))
    assert sorted((str(r.id), *r[1:]) for r in got) == want


def test_diagonal_groups_on_random_arrays():
    rnd = random.Random(3)
    for _ in range(400):
        n = rnd.randint(1, 200)
        a, b = (sorted(rnd.sample(range(n), min(n, int(n * rnd.choice([.05, .5, .97, 1])))) + [n]) for _ in range(2))
        last_a, last_b = cross_tokenizer.diagonal_groups(np.array(a), np.array(b))
        both = set(a) & set(b)
        assert [x in both for x in a] == last_a.tolist() and [x in both for x in b] == last_b.tolist()


def test_forgetting_changes_nothing(monkeypatch):
    texts = odd_texts()[:300]
    with open(A, "rb") as a, open(B, "rb") as b:
        pair = cross_tokenizer.TokenizerPair(a.read(), b.read())
    whole = cross_tokenizer.Block(pair, texts).digests()
    monkeypatch.setattr(cross_tokenizer, "UNIT_ENTRIES", 5)
    assert [d for i in range(0, 300, 50) for d in cross_tokenizer.Block(pair, texts[i:i + 50]).digests()] == whole


@pytest.mark.parametrize("rows", [[], [(1, None, "x", "y"), (None, "", "x", "y"), (2, "word " * 30_000, "x", "y")]])
def test_groups_and_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    assert cross_tokenizer.align(df, A, B).count() == len(rows)
    for r in cross_tokenizer.aligned_groups(df, A, B).collect():
        assert (r.groups == []) == (r.id != 2)
        for g, h in zip(r.groups, r.groups[1:]):
            assert g.stop == h.start and g.a and g.b
