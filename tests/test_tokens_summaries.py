"""Vocabulary lookups, WordPiece, model inputs, collate rows, summaries and the CSV sink."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.functions.arrays import CLS, EOS, PAD, SEP, UNK
from tessera.operators import summaries as SM
from tessera.operators import tokens as TK
from tessera.sources import files as FS

SPECIALS = [PAD, "[unused0]", EOS, UNK, CLS, SEP, "[MASK]"]


def _vocab(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "token string")
    return TK.Vocabulary.from_words(df, SPECIALS)


def test_vocabulary_ids_sorted_after_specials(spark):
    v = _vocab(spark, ["zeta", "alpha", "mid"])
    rows = sorted((r["id"], r["token"]) for r in v.table.collect())
    assert rows == list(enumerate(SPECIALS + ["alpha", "mid", "zeta"]))
    assert v.id_of(CLS) == 4 and v.id_of("zeta") == 9


def test_tokens_ids_roundtrip_and_unknown(spark):
    v = _vocab(spark, ["a", "b"])
    df = spark.createDataFrame([(1, ["a", "x", "b"]), (2, [])], "k int, tokens array<string>")
    ids = TK.tokens_to_ids(df, v, "tokens", "ids")
    back = TK.ids_to_tokens(ids, v, "ids", "back").orderBy("k").collect()
    assert [list(r["ids"]) for r in back] == [[7, 3, 8], []]
    assert [list(r["back"]) for r in back] == [["a", UNK, "b"], []]


def test_model_input_rows_padding(spark):
    v = _vocab(spark, ["a", "b"])
    df = spark.createDataFrame([(1, ["a", "b", "a"])], "k int, words array<string>")
    r = TK.model_input_rows(df, v, "words", seq_length=4).first()
    assert list(r["tokens"]) == [CLS, "a", "b", SEP]  # first seq_length - 2 tokens kept
    assert list(r["input_ids"]) == [4, 7, 8, 5]
    assert list(r["input_mask"]) == [1, 1, 1, 1] and list(r["input_type_ids"]) == [0, 0, 0, 0]


def test_wordpiece_whole_words_and_unknown(spark):
    words = spark.createDataFrame([("Héllo, World!",)], "text string")
    basic = TK.basic_tokenize(words, "text", "w").first()["w"]
    assert list(basic) == ["hello", ",", "world", "!"]
    v = _vocab(spark, ["hello", ",", "world", "!"])
    df = spark.createDataFrame([(1, "hello, world! unknownword")], "k int, text string")
    out = TK.wordpiece_tokenize(df, v, "text", "pieces").first()["pieces"]
    assert list(out) == ["hello", ",", "world", "!", UNK]


def test_collate_and_lead_summary(spark):
    v = _vocab(spark, ["a", "b", "c", "d."])
    stories = spark.createDataFrame([("doc1", ["a b c", "d."], ["sum"]), ("doc2", [], [])],
                                    "document_name string, story_lines array<string>, summary_lines array<string>")
    enc = TK.collate_rows(stories, v, block_size=8).collect()
    assert len(enc) == 1  # empty story dropped
    r = enc[0]
    assert list(r["src"]) == [4, 7, 8, 9, 5, 4, 10, 5]  # [CLS] a b c [SEP] [CLS] d. [SEP]
    assert list(r["segs"]) == [0, 0, 0, 0, 0, 1, 1, 1]
    assert list(r["mask_src"]) == [1] * 8 and r["tgt_str"] == "sum"
    encdf = TK.collate_rows(stories, v, block_size=8)
    gen = SM.lead_generator(v.id_of(CLS), v.id_of(SEP), v.id_of(EOS))
    nbest = SM.summarize(encdf, gen, name="lead-test", key_col="document_name")
    best = SM.best_summary(nbest, v, "document_name").first()
    assert best["summary"] == f"d. {EOS}" and best["score"] == -1.0


def test_summaries_csv_roundtrip_with_quotes(spark):
    df = spark.createDataFrame([(1, "p1", 'Title "q"', "line1\nline2"), (2, "p2", "T2", "s, with comma")],
                               "rank long, paper_id string, title string, summary string")
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-sink-"), "out")
    FS.sink_summaries_csv(df, path)
    back = FS.read_summaries_csv(spark, path).orderBy("index").collect()
    assert [tuple(r) for r in back] == [(0, "p1", 'Title "q"', "line1\nline2"), (1, "p2", "T2", "s, with comma")]


def test_large_vocabulary_falls_back_to_joins(spark):
    words = spark.createDataFrame([(w,) for w in ["a", "b", "c"]], "token string")
    small = TK.Vocabulary.from_words(words, SPECIALS)
    big = TK.Vocabulary.from_words(words, SPECIALS, max_entries=5)  # beyond the bound: no broadcast
    assert small.fits_broadcast and not big.fits_broadcast and big._bc is None
    assert sorted(tuple(r) for r in big.table.collect()) == sorted(tuple(r) for r in small.table.collect())
    df = spark.createDataFrame([(1, ["a", "zz", "c"]), (2, []), (3, ["b", "b"])], "k int, tokens array<string>")
    via_join = {r["k"]: list(r["ids"]) for r in TK.tokens_to_ids(df, big, "tokens", "ids").collect()}
    via_arrow = {r["k"]: list(r["ids"]) for r in TK.tokens_to_ids(df, small, "tokens", "ids").collect()}
    assert via_join == via_arrow == {1: [7, 3, 9], 2: [], 3: [8, 8]}
    back = TK.ids_to_tokens(TK.tokens_to_ids(df, big, "tokens", "ids"), big, "ids", "t")
    assert {r["k"]: list(r["t"]) for r in back.collect()} == {1: ["a", UNK, "c"], 2: [], 3: ["b", "b"]}


def test_vocabulary_file_duplicate_token_keeps_last_line(spark):
    root = tempfile.mkdtemp(prefix="tessera-vocab-")
    path = os.path.join(root, "vocab.txt")
    with open(path, "w") as f:
        f.write("[PAD]\n[UNK]\na\nb\na\n")
    vocab = TK.Vocabulary(FS.load_vocabulary(spark, path))
    assert vocab.id_of("a") == 4
    df = spark.createDataFrame([(1, ["a", "b", "zz"])], "k int, tokens array<string>")
    assert list(TK.tokens_to_ids(df, vocab, "tokens", "ids").first()["ids"]) == [4, 3, 1]
    long = df.select("k", F.posexplode("tokens").alias("pos", "token"))
    rows = sorted((r["pos"], r["id"]) for r in TK.token_ids_long(long, vocab).collect())
    assert rows == [(0, 4), (1, 3), (2, 1)]  # one row per token, no duplicate from the repeated line
