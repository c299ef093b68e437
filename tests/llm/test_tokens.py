import hashlib
import random

import pytest
from pyspark.sql import types as T

from tessera.llm import sentence_pieces, token_counts
from tessera.llm.common import ModelFile, TwoGenerationCache, tokenizer_path

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("n_tokens", T.StringType()), T.StructField("id", T.StringType())])


def odd_texts():
    rnd = random.Random(4)
    letters = "ab cd  \n\t'sx1 é▁<|endoftext|>ßÀ中𝔸 龘   \x85\x1c\x00ll"
    out = ["", "  ", " ", "a" * 5000, " " * 70, "▁▁a ▁ b", "x  y   z    w", " 中 梦  龘 ", "<|endoftext|>",
           "a<|endoftext|> b <|endoftext|><|endoftext|>", "it's WE'LL 123 4 !!? ...", "é" * 700]
    out += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 90))) for _ in range(600)]
    return out + [" " * i + w for i in range(36) for w in ("", "a", "龘", "\n")]


def test_counts_equal_the_library():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(BPE)
    mine = token_counts.BytePairCounter(ModelFile(BPE).data)
    for text in odd_texts():
        assert mine.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert len(mine.whole) > 45_000
    for word in [" the", "hello", "zqzqzq" * 40, "é" * 300]:
        assert mine._merge_long([bytes([b]) for b in word.encode()]) == mine.merge(word.encode())


def test_pieces_equal_the_library():
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    mine = sentence_pieces.PieceModel(ModelFile(PIECES).data)
    for text in odd_texts():
        ids = library.encode(text)
        assert mine.encode(text) == ids, repr(text)
        assert mine.decode(ids) == library.decode(ids)
        joined = ",".join(map(str, ids)).encode()
        assert mine.digests(text) == (len(ids), hashlib.sha256(joined).hexdigest(),
                                      hashlib.sha256(library.decode(ids).encode()).hexdigest())
    rnd = random.Random(6)
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(259), rnd.randrange(32000)]) for _ in range(rnd.randint(0, 9))]
        assert mine.decode(ids) == library.decode(ids)


def test_cache_forgets_but_answers_the_same():
    cache = TwoGenerationCache(2)
    for k in "abc":
        cache[k] = k
    cache.rotate()
    assert cache.lookup("a") == "a" and len(cache) == 1 and cache.lookup("z") is None


@pytest.mark.parametrize("rows", [[], [(1, None, "x", "y"), (None, "", "x", "y"), (2, "a  b", "x", "y"), (2, "a  b", "x", "y"),
                                       (3, "word " * 40_000, "x", "y")]])
def test_queries_over_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    counts = token_counts.count_tokens(df, BPE).collect()
    assert len(counts) == len(rows)
    for r in counts:
        assert r.over_limit == (r.n_tokens > 1024)
    got = sentence_pieces.encode_digests(df, PIECES).collect()
    assert len(got) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in got if r.id in (1, None))
    both = sentence_pieces.decode(sentence_pieces.encode(df, PIECES), PIECES, text_col="again")
    assert all(r.again == (r.text or "") for r in both.collect())
