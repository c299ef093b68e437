import itertools
import random

import pytest
from pyspark.sql import types as T

from tessera.llm import dom, page_text

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("host", T.StringType()), T.StructField("text", T.StringType())])


def random_tree(rnd, depth=3):
    return (rnd.choice("abc"), tuple(random_tree(rnd, depth - 1) for _ in range(rnd.randint(0, 3 if depth else 0))))


def brute_match(a, b):
    """Largest order-keeping match with matching roots, by trying all pairings of children."""
    if a[0] != b[0]:
        return 0
    best = 0
    for k in range(min(len(a[1]), len(b[1])) + 1):
        for xs in itertools.combinations(range(len(a[1])), k):
            for ys in itertools.combinations(range(len(b[1])), k):
                parts = [brute_match(a[1][x], b[1][y]) for x, y in zip(xs, ys)]
                best = max(best, sum(parts)) if all(parts) else best
    return best + 1


def test_matching_equals_all_pairings():
    rnd = random.Random(2)
    for _ in range(150):
        a, b = random_tree(rnd), random_tree(rnd)
        b = (a[0], b[1])
        assert dom.matching(a, b, {}) == brute_match(a, b)
        merged = dom.merge(a, b)
        assert dom.size(merged) == dom.size(a) + dom.size(b) - dom.matching(a, b, {})
        assert all(p >= 0 for p in dom.places(merged, a)) and len(set(dom.places(merged, a))) == dom.size(a)


def texts(page):
    _, blocks = dom.parse(page)
    return [b[1] for b in page_text.articles(blocks)]


@pytest.mark.parametrize("page,want", [
    ("<p>a&amp;b  &lt;x&gt;\n c&nbsp;d<br>e<p>two<b>three</b> four", ["a&b <x> c d e", "twothree four"]),
    ("<nav>m</nav><article><h1>T</h1><p>x<div class=ad>no</div>y<aside>no</aside><form>no<p>no</form></article><footer>f</footer>out", ["T", "x", "y"]),
    ("<body>1 < 2 <!-- <p>no --> ok<script>var a='<p>no</p>'</script><style>p{}</style>", ["1 < 2 ok"]),
    ("<div id=comments><p>no</div><div class='cookie-notice'>no</div><div class=story>yes<ul><li>one<li>two</ul></div>", ["yes", "one", "two"]),
    ("<article><p>main</p><span class=\"share\">no</span> more<article class=comment>no</article></article>", ["main", "more"]),
    ("text </div></p> on <unknown>x</unknown>", ["text", "on x"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("", []), ("<", ["<"]), ("<p", ["<p"]), ("&#65;&unknown;&amp", ["A&unknown;&"]),
    ("<main><header>no</header><p hidden>no</p><p style='display:none'>no</p><section><p>s</section></main><p>out", ["s"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_deep_and_wide_pages():
    deep = "<div>" * 5000 + "core" + "</div>" * 5000 + "<p>end"
    tree, blocks = page_text._placed(deep)
    assert [b[1] for b in blocks] == ["core", "end"] and all(b[0].place >= 0 for b in blocks)
    wide = "".join(f"<h2>{i}</h2><p>x{i}" for i in range(2000))
    tree, blocks = page_text._placed(wide)
    assert len(blocks) == 4000
    again, _ = page_text._placed(wide + "<h3>new</h3>")
    merged = dom.merge(tree, again)
    assert all(p >= 0 for p in dom.places(merged, again))


def corpus():
    rnd = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        body = [" ".join(f"w{rnd.randrange(900)}" for _ in range(12)) for _ in range(rnd.randint(1, 6))]
        host = "hot.example.org" if i % 3 else f"h{i}.example.org"
        extra = "<div class=x9><p>Welcome to our site</p></div>" if i % 3 else ""
        links = "".join(f"<div><a href=/>topic {rnd.randrange(99)}</a></div>" for _ in range(3))
        rows.append((i, f"http://{host}/{i}", f"<html><body><ul class=nav><li>x</ul>{extra}<div class=body><p>" + "</p><p>".join(body) + f"</p></div>"
                     f"<section>{links}</section></body></html>", "clash", "clash"))
        want[i] = " ".join(body)
    return rows, want


def test_varying_slots_are_content(spark):
    rows, want = corpus()
    got = {r.id: r.text for r in page_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert {i: got[i] for i in want if i % 3} == {i: t for i, t in want.items() if i % 3}
    assert all(got[i].startswith(want[i]) or got[i].endswith(want[i]) for i in want)


def test_odd_rows(spark):
    rows = [(1, None, "<p>a", "", ""), (2, "nonsense", None, "", ""), (None, "http://H/x", "<p>b c", "", ""), (3, "http://h/y", "", "", ""),
            (4, "http://u:p@h:80/z", "<p>" + "long " * 200_000, "", ""), (1, None, "<p>a", "", "")]
    got = sorted(((r.id, r.url, len(r.text)) for r in page_text.main_text(spark.createDataFrame(rows, PAGES)).collect()), key=str)
    assert got == sorted([(1, None, 1), (1, None, 1), (2, "nonsense", 0), (3, "http://h/y", 0), (4, "http://u:p@h:80/z", 999_999), (None, "http://H/x", 3)], key=str)
    assert page_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_given_pages_give_their_article(spark):
    import html
    import re
    from conftest import SF
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.id: r.text for r in page_text.main_text(pages).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        blocks = re.sub(r"</?(?:p|h1)>", "\0", re.sub(r"</?b>", "", inner.replace("<br>", " "))).split("\0")
        assert got[r.page_id] == " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_copies_of_a_page_keep_their_article(spark):
    page = "<html><body><div><p>Site name</p></div><div class=body><p>%s</p></div></body></html>"
    rows = [(i, f"http://copies.org/{i}", page % "one story in many copies", "", "") for i in range(40)]
    rows += [(100 + i, f"http://some.org/{i}", page % (f"story {i}" if i < 6 else "the copied story"), "", "") for i in range(200)]
    got = {r.id: r.text for r in page_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert {got[i] for i in range(40)} == {"Site name one story in many copies"}
    assert [got[100 + i] for i in range(8)] == [f"story {i}" for i in range(6)] + ["the copied story"] * 2


LONG = "a sentence of the story that is long enough to be told from a label, and then some more words of it to be sure"


@pytest.mark.parametrize("page,want", [
    ("<div class='content no-sidebar'><p>story</div>", ["story"]), ("<div class=has-header><p>story</div>", ["story"]),
    ("<form><div><p>story</div></form>", ["story"]), ("<div class=widget><article><p>story</article></div>", ["story"]),
    (f"<article><div class=entry-header><h1>T</h1></div><h2 id=search>S</h2><section id=social-history>{LONG}</section></article>", ["T", "S", LONG]),
    (f"<article><p>x</p><section id=social>{LONG}</section><p>{LONG}</article>", ["x", LONG, LONG]),
    (f"<p>{LONG}<div class=related><a href=/>{LONG}</a></div>", [LONG]),
    (f"<div class=body><p>{LONG}<p>{LONG}<p>{LONG}</div><div id=comments><p>{LONG}</div>", [LONG] * 3),
    (f"<p>story</p><section id=comments><article class=comment><p>{LONG}</article><article class=comment><p>{LONG}</article></section>", ["story"]),
    (f"<article><p>{LONG}</p><div class=comments><p>{LONG}</div></article>", [LONG]),
    (f"<article><p>{LONG}</p><article class=comment><p>{LONG}</article></article>", [LONG]),
    *[(f"<div class=body><p>{LONG}<p>{LONG}</div><div class={name}><p>{LONG}</div>", [LONG] * 2) for name in ("sidebar", "cookie-notice", "advert")],
    (f"<div class=widget><p>{LONG}</div><p>end", [LONG, "end"]),
])
def test_names_alone_do_not_decide(page, want):
    assert texts(page) == want


def test_linked_headings_and_references_stay(spark):
    page = "<article><h1><a href=/%d>Title %d</a></h1><p>story %d</p><ol><li><a href=/r>source %d</a></ol></article>"
    rows = [(i, f"http://linked.org/{i}", page % (i, i, i, i), "", "") for i in range(20)]
    got = {r.id: r.text for r in page_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Title {i} story {i} source {i}" for i in range(20)}
