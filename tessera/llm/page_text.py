"""Main text of web pages by wrapper induction over the pages of each host.

The block trees of a host's pages are aligned by simple tree matching and merged into one
template tree. Blocks whose text is the same on nearly all pages at the same node, and nodes
that hold little but links, are template; the varying slots are content.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import written

#: a block is template if at least this part of the pages with its node have it, of so many pages
CONSTANT_SHARE, CONSTANT_PAGES = 0.95, 5
#: a node is template if more than this part of its text is inside links
LINK_SHARE = 0.5
#: parts into which the skeletons of one host are dealt before their templates are merged
SALTS = 16


def host_column(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _placed(page: str) -> tuple:
    """``(skeleton, blocks)`` of a page, blocks with their nodes numbered in the skeleton."""
    root, blocks = dom.parse(page)
    tree = dom.skeleton(root)
    dom.number(root, tree)
    return tree, blocks


def articles(blocks: list) -> list:
    """The blocks that may be content: those outside menus, forms and the like, and inside
    ``article`` (else ``main``) elements if the page has text in such."""
    open_ = [b for b in blocks if not b[0].zone]
    for tag in ("article", "main"):
        inside = [b for b in open_ if _within(b[0], tag)]
        if inside:
            return inside
    return open_


def _within(node, tag: str) -> bool:
    while node is not None:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def _headline_or_article(node) -> bool:
    """Whether a node may be mostly links and content still: a heading, or part of an article."""
    return node.tag in dom.HEADINGS or _within(node, "article") or _within(node, "main")


def page_blocks(pages: DataFrame) -> DataFrame:
    """``(host, skeleton, places, hashes, chars, linked)`` of every page that has blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "skeleton", "places", "hashes", "chars", "linked"]
        kinds = [pa.string(), pa.string(), *[pa.list_(pa.int64())] * 4]
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree, blocks = _placed(page or "")
                kept = articles(blocks)
                rows.append((host, json.dumps(dom.to_list(tree)), [b[0].place for b in kept], [_hash(b[1]) for b in kept],
                             [len(b[1]) for b in kept], [b[2] for b in kept]))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return pages.select("host", "html").mapInArrow(run, "host string, skeleton string, places array<long>, hashes array<long>, "
                                                        "chars array<long>, linked array<long>")


def host_templates(found: DataFrame) -> DataFrame:
    """``(host, template)``: the skeletons of each host merged, most frequent first.

    Skeletons are counted before they are dealt out, so a host with a third of all pages
    sends each of its shapes once; shapes are merged in salted parts, then the parts.
    """
    shapes = found.groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("n"))

    def merged(pdf):
        import pandas as pd
        pdf = pdf.sort_values(["n", "skeleton"], ascending=[False, True])
        template = None
        for text in pdf["skeleton"]:
            tree = dom.from_list(json.loads(text))
            template = tree if template is None else dom.merge(template, tree)
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "skeleton": [json.dumps(dom.to_list(template))], "n": [int(pdf["n"].sum())]})

    ddl = "host string, skeleton string, n long"
    parts = (shapes.withColumn("salt", F.pmod(F.xxhash64("skeleton"), F.lit(SALTS)))
             .groupBy("host", "salt").applyInPandas(lambda pdf: merged(pdf), ddl))
    return parts.groupBy("host").applyInPandas(lambda pdf: merged(pdf), ddl).select("host", F.col("skeleton").alias("template"))


def induce_wrappers(pages: DataFrame, constant_share: float = CONSTANT_SHARE, constant_pages: int = CONSTANT_PAGES,
                    link_share: float = LINK_SHARE) -> DataFrame:
    """``(host, template, constants, links)`` per host of ``pages(host, html)``: the merged
    tree, the (node, text hash) pairs that are template, and the nodes that are mostly links."""
    found = written(page_blocks(pages), "blocks")
    templates = written(host_templates(found), "templates")
    # copies of a page are one page: constancy is judged over pages that differ
    found = (found.groupBy("host", F.xxhash64("hashes").alias("content"), F.xxhash64(F.lit(1), "hashes").alias("content2"))
             .agg(F.min(F.struct("skeleton", "places", "hashes", "chars", "linked")).alias("page")).select("host", "page.*"))
    found = written(found, "page-contents")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            out: list = [[], [], [], [], [], []]
            for host, shape, places, hashes, chars, linked, template in zip(*cols):
                where = _where(memo, template, shape)
                seen, met = set(), set()
                for p, h, c, k in zip(places, hashes, chars, linked):
                    node = where[p]
                    for col, v in zip(out, (host, node, h, c, k, int(node not in met))):
                        col.append(v if col is not out[2] or (node, h) not in seen else None)
                    met.add(node)
                    seen.add((node, h))  # a text counts once per page; its characters always
            yield pa.record_batch([pa.array(out[0], pa.string()), *[pa.array(c, pa.int64()) for c in out[1:]]], ["host", "node", "h", "chars", "linked", "page"])

    rows = (found.join(templates, "host").select("host", "skeleton", "places", "hashes", "chars", "linked", "template")
            .mapInArrow(align, "host string, node long, h long, chars long, linked long, page long").where("node >= 0"))
    texts = rows.groupBy("host", "node", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
                                                F.sum("page").alias("on_pages"))
    texts = written(texts, "texts")
    n_pages = found.where("size(places) > 0").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = (texts.where("h is not null and n >= %d" % constant_pages).join(n_pages, "host")
             .where(F.col("n") >= constant_share * F.col("pages"))
             .groupBy("host").agg(F.collect_list(F.struct("node", "h")).alias("constants")))
    mostly = (texts.groupBy("host", "node").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum("on_pages").alias("on_pages"))
              .where((F.col("linked") > link_share * F.col("chars")) & (F.col("on_pages") >= constant_pages))
              .groupBy("host").agg(F.collect_list("node").alias("links")))
    return templates.join(often, "host", "left").join(mostly, "host", "left")


def _where(memo: dict, template: str, shape: str) -> list:
    key = (template, shape)
    if key not in memo:
        if len(memo) > 500:
            memo.clear()
        memo[key] = dom.places(dom.from_list(json.loads(template)), dom.from_list(json.loads(shape)))
    return memo[key]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` per row: the blocks of the page's varying slots, joined by spaces.

    Pages are aligned with the pages of their host only; pages without a host (null or odd
    urls) form one group. Null and empty pages have empty text. Character references are
    decoded, white space in a block becomes one space. Copies of a page count once; a host
    with fewer than ``CONSTANT_PAGES`` differing pages has no constant blocks. Repeated rows and null ids stay; other
    columns are ignored; empty tables give an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        host_column(url_col).alias("host"), F.col(html_col).alias("html"))
    wrappers = written(induce_wrappers(rows.select("host", "html")), "wrappers")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        known: dict = {}
        for batch in batches:
            texts = []
            cols = [batch.column(i).to_pylist() for i in range(2, 7)]
            for page, host, template, constants, links in zip(*cols):
                if not page:
                    texts.append("")
                    continue
                tree, blocks = _placed(page)
                where = _where(memo, template, json.dumps(dom.to_list(tree)))
                if host not in known:
                    if len(known) > 500:
                        known.clear()
                    known[host] = ({(c["node"], c["h"]) for c in constants or []}, set(links or []))
                fixed, linky = known[host]
                kept = []
                for node, text, _ in articles(blocks):
                    place = where[node.place]
                    if (place not in linky or _headline_or_article(node)) and not (fixed and (place, _hash(text)) in fixed):
                        kept.append(text)
                texts.append(" ".join(kept))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    joined = rows.join(wrappers, "host", "left").select("id", "url", "html", "host", "template", "constants", "links")
    return joined.mapInArrow(extract, "id long, url string, text string")
