import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import range_coder, token_files
from tessera.llm.common import ModelFile, tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType()),
                     T.StructField("part", T.StringType())])


@pytest.mark.parametrize("lanes", [3, 4096])
def test_blocks_round_trip(monkeypatch, lanes):
    monkeypatch.setattr(range_coder, "LANES", lanes)
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, n) for n in (0, 1, 2, 50, 700)] + [np.zeros(600, int), np.full(300, 65535), np.arange(1000) % 7]
    blocks += [np.minimum(rng.zipf(1.3, 1024), 60000)]
    coded = range_coder.encode_blocks(blocks)
    back = range_coder.decode_blocks(coded, list(map(len, blocks)))
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
    assert len(coded[5]) < 60 and len(coded[7]) < 100  # what is predicted costs next to nothing
    alone = range_coder.encode_blocks([blocks[4]])[0]
    assert alone == coded[4]  # a block does not hang on the others
    assert range_coder.encode_blocks([]) == [] and range_coder.decode_blocks([], []) == []
    with pytest.raises(ValueError):
        range_coder.encode_blocks([np.array([65536])])


def test_lower_bytes_are_modelled():
    rng = np.random.default_rng(2)
    blocks = [0x1230 + rng.integers(0, 16, 1024), rng.integers(0, 4, 1024) * 4096 + 0x567]
    coded = range_coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode_blocks(coded, [1024, 1024])))
    assert len(coded[0]) < 1024 * 5.5 / 8 and len(coded[1]) < 1024 * 3.5 / 8  # 4 and 2 bits an id without predictions


@pytest.mark.parametrize("factors", [None, 0])
def test_different_words_are_cut_once(monkeypatch, factors):
    if factors is not None:  # all words have equal hashes
        monkeypatch.setattr(token_files, "HASH", np.full(3, factors, np.uint64))
    rnd = random.Random(4)
    some = ["", "a", "b\0", "b", "a\0\0", "é" * 4, "12345678", "123456789", "x" * 24, "x" * 25, "x" * 23 + "y", "y" * 70, "中" * 90, "\x85z"]
    for n in (0, 1, 5, 3000):
        data = ("".join(rnd.choice(some) + rnd.choice(" \t\n\x0b\x0c\r") for _ in range(n)) + " ").encode()
        starts, sizes, words, codes = token_files.cut_words(data)
        assert [words[c] for c in codes] == data.split() == [data[a:a + k] for a, k in zip(starts, sizes)]
        assert len(set(words)) == len(words) and set(words) >= set(data.split())


def test_stretches_of_text_ask_for_different_words_only(monkeypatch):
    from tokenizers import Tokenizer
    library = Tokenizer.from_str(ModelFile(WORDS).data.decode())
    texts = ["", "the cat, the dog " * 400, "", "one two\n" * 300, "z" * 5000, " ", "the " * 7]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for chunk in (1, 50, 4000, 1 << 20):
        monkeypatch.setattr(token_files, "CHUNK", chunk)
        mine, asked = token_files.WordEncoder(ModelFile(WORDS).data), []
        look_up = mine.cache.all
        mine.cache.all = lambda words, make: asked.append(len(words)) or look_up(words, make)
        assert [np.frombuffer(b, "<u2").tolist() for b in mine.encode([t.encode() for t in texts])] == want
    assert asked == [6] and mine.encode([]) == []


def test_words_equal_the_library():
    from tokenizers import Tokenizer
    library = Tokenizer.from_str(ModelFile(WORDS).data.decode())
    mine = token_files.WordEncoder(ModelFile(WORDS).data)
    rnd = random.Random(3)
    letters = "abIT's  \n\té1ßÀ中𝔸   \x85\x1c\x0b́<|endoftext|>ll"
    texts = ["", " ", "It's WE'LL", "<|endoftext|>a <|endoftext|>", "x" * 3000] + ["".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(800)]
    for t, got in zip(texts, mine.encode([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_that_share_letters_are_encoded_once(monkeypatch):
    from tokenizers import Tokenizer
    library = Tokenizer.from_str(ModelFile(WORDS).data.decode())
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 300)  # memos forget while texts are read
    mine, alone = token_files.WordEncoder(ModelFile(WORDS).data), []

    class Noted:
        def encode_batch_fast(self, words, **how):
            alone.extend(words)
            return library.encode_batch_fast(words, **how)

    mine.library = Noted()
    rnd = random.Random(5)
    stems = ["".join(rnd.choices("abcdeéñÀß", k=rnd.randint(1, 12))) for _ in range(900)]
    forms = [f for w in stems for f in (w, w.upper(), w.capitalize() + ".", w + '!?"', w + ",")]
    texts = [" ".join(forms[i:i + 500]) for i in range(0, len(forms), 500)] + ["<|endoftext|> a<|b|> it's, '' \u0301. a\u0301. Ωσ ΟΔΟΣ. aª ×a ı İ. \x85x\x1c. " + "Y" * 3000 + "."]
    for lot in (texts, texts[::-1]):
        for t, got in zip(lot, mine.encode([t.encode() for t in lot])):
            assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(alone) < 60


def test_other_steps_before_the_model_go_word_by_word():
    import json

    from tokenizers import Tokenizer
    file = json.loads(ModelFile(WORDS).data)
    file["normalizer"] = {"type": "NFC"}  # upper case stays
    data = json.dumps(file)
    library, mine = Tokenizer.from_str(data), token_files.WordEncoder(data.encode())
    for t in ("The END. the end, Été", ""):
        assert np.frombuffer(mine.encode([t.encode()])[0], "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_damaged_files_raise():
    writer = token_files.FileWriter(4)
    for i in range(5):
        writer.add(i, np.arange(i * 700, dtype="<u2").tobytes())
    data = b"".join(s + b"\n" for s in writer.sections(True))
    rows = list(token_files.read_file(data))
    assert [(p, d, s, len(x)) for p, d, s, x in rows] == [(4, i, sum(k * 700 for k in range(i)), i * 700) for i in range(5)]
    for bad in (data[:-1], data[:len(data) // 2], data[:40] + bytes([data[40] ^ 1]) + data[41:]):
        with pytest.raises(ValueError):
            list(token_files.read_file(bad))


def test_query_equals_brute_force(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_str(ModelFile(WORDS).data.decode())
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choices(["the", "Zebra's", "x1y", "été", "\n"], k=rnd.randint(0, 400))), "c", "c") for i in rnd.sample(range(10_000), 150)]
    rows += [(20_000, None, "", ""), (20_001, "", "", ""), (20_002, "long " * 30_000, "", ""), (None, "first", "", "")]
    got = sorted(map(tuple, token_files.round_trip(spark.createDataFrame(rows, DOCS), WORDS).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.round_trip(spark.createDataFrame([], DOCS), WORDS).count() == 0
    twice = [(1, "a b", "", "")] * 2
    assert sorted(r.start for r in token_files.round_trip(spark.createDataFrame(twice, DOCS), WORDS).collect()) == [0, 3]
