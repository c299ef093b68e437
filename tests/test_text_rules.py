"""Golden rows for the Python string rules, checked against plain-Python statements."""

from collections import deque

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import strings as S


def py_process_story(raw):
    lines = [x.strip() for x in raw.split("\n")]
    lines = [x for x in lines if len(x) != 0]
    ends = [".", "!", "?", "...", "'", "`", '"', "’", "’", ")"]
    lines = [x if x.startswith("@highlight") or x[-1] in ends else x + "." for x in lines]
    story, q = [], deque(lines)
    while q:
        e = q.popleft()
        if e.startswith("@highlight"):
            return story, [t for t in q if not t.startswith("@highlight")]
        story.append(e)
    return story, []


EDGE_STORIES = [
    "", "\n\n  \n", "no marker here", "@highlight\nfirst", "line\n@highlight", "a\n@highlighted\nb",
    "ends.\nends!\nends?\nends'\nends`\nends\"\nends’\nends)\nplain",
    "\t\x0b\x1c\x85\xa0　 padded 　\n@highlight\n sum one \n@highlight\nsum two",
    "x\r\ny", "story\n@highlight\n@highlight\nlast",
]


def _process(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    lines = S.story_lines(F.col("raw"))
    out = df.select("i", S.story_part(lines).alias("s"), S.summary_part(lines).alias("m")).orderBy("i").collect()
    return [(list(r["s"]), list(r["m"])) for r in out]


def test_story_rules_edge_cases(spark):
    assert _process(spark, EDGE_STORIES) == [py_process_story(t) for t in EDGE_STORIES]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", " ", "\n", "@highlight", "　", "x)", "\t", "q?"]), max_size=12))
def test_story_rules_property(spark, parts):
    raw = "".join(parts)
    assert _process(spark, [raw]) == [py_process_story(raw)]


def test_strip_and_normalize(spark):
    texts = ["  a b ", "\x1c\x1dx\x1e\x1f", "\u2028y\u2029", "a \t\n b\u3000c", "", " \x85\u3000\n", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(S.py_strip("t").alias("s"), S.normalize_whitespace("t").alias("n"),
                     S.has_text("t").alias("h")).collect()
    assert [r["s"] for r in rows] == [t.strip() for t in texts]
    assert [r["h"] for r in rows] == [t.strip() != "" for t in texts]
    assert [r["n"] for r in rows] == [" ".join(t.split()) for t in texts]


def test_split_pair(spark):
    import re
    lines = ["a ||| b", "a ||| b ||| c", "a ||| ", "", "only a", " x ||| y z "]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    rows = df.select(S.split_pair_a("t").alias("a"), S.split_pair_b("t").alias("b")).collect()
    for line, r in zip(lines, rows):
        s = line.strip()
        m = re.match(r"^(.*) \|\|\| (.*)$", s)
        exp = (s, None) if m is None else (m.group(1), m.group(2))
        assert (r["a"], r["b"]) == exp


def test_detokenize_and_document_name(spark):
    df = spark.createDataFrame([(["##x", "un", "##aff", "##able", "[SEP]"], "a/b/c.json")], "t array<string>, p string")
    r = df.select(S.detokenize("t").alias("d"), S.document_name("p").alias("n")).first()
    assert r["d"] == " ".join(["##x", "un", "##aff", "##able", "[SEP]"]).replace(" ##", "")
    assert r["n"] == "c.json"


def test_every_character_is_told_from_whitespace(spark):
    chars = [chr(i) for i in range(0x3100) if i != 0x1C89 and "a{}b".format(chr(i)).lower() == "a{}b".format(chr(i))]
    df = spark.createDataFrame([(i, f"a{c}b {c}") for i, c in enumerate(chars)], "i int, t string")
    rows = df.select("i", S.words("t").alias("w"), S.py_strip("t").alias("s"), S.normalize_whitespace("t").alias("n"), S.has_text(F.lit("x")).alias("h")).collect()
    for r in rows:
        text = f"a{chars[r.i]}b {chars[r.i]}"
        assert (r.w, r.s, r.n) == (text.split(), text.strip(), " ".join(text.split())), repr(text)
