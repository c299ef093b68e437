"""WordPiece with a vocabulary that may not be broadcast: same pieces as with one that is."""

from tessera.operators import tokens as TK


def test_joined_vocabulary_gives_the_same_pieces(spark):
    entries = ["[UNK]", "un", "##aff", "##able", "##ab", "hello", "a", "##b", "##c", ",", "wörd", "x" * 100, "y" * 101, "word", "中"]
    table = spark.createDataFrame([(t, i) for i, t in enumerate(entries)], "token string, id int")
    texts = ["Unaffable hello, WORLD", "abc abd hello hello", "", None, "x" * 100 + " " + "y" * 101, "Wörd 中文 a,b  unable", "unaffable" * 12]
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts * 2)], "word long, text string").repartition(3)

    def pieces(most):
        return sorted(map(str, TK.wordpiece_tokenize(df, TK.Vocabulary(table, max_entries=most)).collect()))

    assert pieces(1000) == pieces(1)
