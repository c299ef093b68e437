"""Block trees of HTML pages and their alignment by simple tree matching."""

from __future__ import annotations

import html
import math
import re

import numpy as np

# Element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset("""html head body address article aside blockquote button canvas caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol option p pre search section
select summary table tbody td tfoot th thead tr ul hr""".split())
#: elements that end an open paragraph
ENDS_P = BLOCK - frozenset("html head body caption button option legend summary td th tr tbody thead tfoot dt dd li figcaption".split())
#: start tag -> the open siblings that it ends, and what they may not be looked for beyond
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
FENCE = frozenset("ul ol menu dl table select article section div main aside nav header footer form".split())
#: elements that are not the article
ZONE_TAGS = frozenset("""nav header footer aside form script style noscript template iframe svg math button select textarea dialog menu head
title object canvas search fieldset""".split())
#: class, id and role words of parts that are not the article
ZONE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion cookie
cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related recommended
recommendations sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs comment comments disqus replies
respond footer header masthead topbar popup modal overlay pagination pager toolbar contentinfo complementary search""".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENTS = frozenset("comment comments respond".split())
#: inside an article, a part that only its name calls no article is none if its text is shorter, or mostly links
LITTLE_TEXT = 100

#: elements nested deeper count as part of their ancestor at this depth when trees are aligned
MAX_DEPTH = 100
#: child lists with more pairs to compare get their table a row at a time (the same match, less memory)
MAX_PAIRS = 40_000


class Node:
    """An element that makes blocks: its label, its children and its place in the skeleton."""

    __slots__ = ("tag", "label", "zone", "named", "said", "inside", "chars", "linked", "holds", "children", "parent", "place", "depth")

    def __init__(self, tag: str, label: str, zone: bool, parent, named: str = ""):
        self.tag, self.label, self.zone, self.parent, self.named = tag, label, zone, parent, bool(named)
        self.said = named == "comments"  # readers' comments
        self.inside = parent is not None and (parent.inside or (parent.tag in ("article", "main") and not parent.said))
        self.chars = self.linked = 0
        self.holds = False  # an article, main or h1 element below it
        self.children: list = []
        self.place = -1
        self.depth = parent.depth + 1 if parent is not None else 0


def _label(tag: str, attributes: str) -> tuple:
    """(label, whether it is a part that is not the article, what its name alone says it is).

    A name says so if all its words do: ``sidebar`` and ``cookie-notice``, not ``no-sidebar``. It says
    "comments", "other" or nothing.
    """
    zone, named = tag in ZONE_TAGS, ""
    if not attributes:
        return tag, zone, named
    names = []
    for m in NAME.finditer(attributes):
        for name in (m.group(2) or m.group(3) or m.group(4) or "").split():
            found = [w.lower() for w in WORD.findall(name)]
            names += found
            said = not COMMENTS.isdisjoint(found)
            if tag == "article":
                named = "comments" if said else named
            elif tag not in ("html", "body", "main") and tag not in HEADINGS and found and ZONE_WORDS.issuperset(found):
                named = "comments" if said else named or "other"
    if not zone and tag not in ("html", "body", "main", "article"):
        zone = bool(HIDDEN.search(attributes))
    return (f"{tag}.{'.'.join(names)}" if names else tag), zone, named


def _judge(nodes: list, blocks: list) -> None:
    """Settles which nodes (parents first) are no article, now that their text is known."""
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
    total = sum(len(text) for _, text, _ in blocks)
    for node in reversed(nodes):
        up = node.parent
        up.chars, up.linked = up.chars + node.chars, up.linked + node.linked
        up.holds = up.holds or node.holds and not node.said or node.tag in ("article", "main", "h1") and not node.said
    for node in nodes:
        if node.tag in ("form", "fieldset"):  # not if it wraps the article or most of the page
            node.zone = not node.holds and 2 * node.chars <= total
        elif node.said and not node.zone:  # readers' comments, inside the article too
            node.zone = not node.holds
        elif node.named and not node.zone:
            # inside an article or main element only if it is short; outside unless it is most of the page
            little = (node.chars < LITTLE_TEXT or not node.inside) and 2 * node.chars <= total
            node.zone = not node.holds and (little or 2 * node.linked > node.chars)
        node.zone = node.zone or node.parent.zone


def parse(page: str) -> tuple:
    """``(root, blocks)``: the tree of block elements and the text blocks in page order, each
    as (node, text, characters inside links)."""
    root = Node("#", "#", False, None)
    at, node, blocks, parts, linked, in_link = 0, root, [], [], 0, 0
    raw_end, nodes = None, []

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((node, text, min(linked, len(text))))
            parts, linked = [], 0

    def add(text):
        nonlocal linked
        if text:
            text = html.unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text)

    def close(names, fence):
        """Ends the nearest open element of some names, with all in it."""
        nonlocal node
        up = node
        while up is not root and up.tag not in names:
            if up.tag in fence:
                return
            up = up.parent
        if up is not root:
            flush()
            node = up.parent

    position = 0
    while True:
        if raw_end is not None:
            m = re.compile(rf"</{raw_end}(?=[\s/>])[^>]*>", re.I).search(page, position)
            position = m.end() if m else len(page)
            raw_end = None
            at = position
        m = TOKEN.search(page, position)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = position = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag == "p":
                flush()
                close(("p",), FENCE)
            elif tag in BLOCK and tag not in VOID:
                flush()
                close((tag,), ("article",) if tag in ("div", "section", "p", "li", "ul", "ol") else ())
            continue
        attributes = m.group(3)
        if tag in RAW:
            if not attributes.endswith("/"):
                raw_end = tag
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                parts.append(" ")
            continue
        if tag == "a":
            in_link = 1
        label, zone, named, end = None, False, "", None
        if tag not in BLOCK:
            if attributes and tag not in VOID:
                label, zone, named = _label(tag, attributes)
            if not (zone or named) or tag in VOID:
                continue  # inline elements make no blocks
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
            if not zone and (tag == "a" or end is None or end.start() - position >= LITTLE_TEXT):
                continue
        if tag in ENDS_P:
            close(("p",), FENCE)
        if tag in ENDS:
            close(ENDS[tag], FENCE)
        flush()
        if tag == "hr":
            continue
        if label is None:
            label, zone, named = _label(tag, attributes)
        child = Node(tag, label, zone, node, named)
        node.children.append(child)
        nodes.append(child)
        if tag in BLOCK:
            node = child
        else:  # an inline element that is no part of the article, such as span.ad: to its end tag
            at = position = end.end() if end else position
    flush()
    _judge(nodes, blocks)
    return root, blocks


# -- skeletons: trees as nested tuples (label, children)

def skeleton(node: Node) -> tuple:
    """The tree of labels with rows of equal siblings folded into one."""
    folded: list = []
    for child in node.children if node.depth < MAX_DEPTH else ():
        s = skeleton(child)
        if folded and folded[-1][0] == s[0]:
            folded[-1] = merge(folded[-1], s)
        else:
            folded.append(s)
    return (node.label, tuple(folded))


def size(tree: tuple) -> int:
    return 1 + sum(map(size, tree[1]))


def matching(a: tuple, b: tuple, memo: dict) -> int:
    """Nodes of the largest order-keeping match of two trees whose roots match."""
    if a[0] != b[0]:
        return 0
    if a == b:
        return size(a)
    key = (a, b)
    if key not in memo:
        if len(a[1]) * len(b[1]) > MAX_PAIRS:
            row, weights = np.zeros(len(b[1]) + 1, np.int64), _weights(b[1], memo)
            for x in a[1]:
                row = _next_row(row, weights(x))
            memo[key] = 1 + int(row[-1])
        else:
            memo[key] = 1 + _table(a[1], b[1], memo)[-1][-1]
    return memo[key]


def _table(xs: tuple, ys: tuple, memo: dict) -> list:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        last, row = rows[-1], [0]
        for j, y in enumerate(ys):
            row.append(max(row[j], last[j + 1], last[j] + matching(x, y, memo)))
        rows.append(row)
    return rows


def aligned(xs: tuple, ys: tuple, memo: dict) -> list:
    """Pairs (i, j) of matched children, in order."""
    if [x[0] for x in xs] == [y[0] for y in ys]:
        return [(i, i) for i in range(len(xs))]
    if len(xs) * len(ys) > MAX_PAIRS:
        return _aligned_long(xs, ys, memo)
    rows, i, j, pairs = _table(xs, ys, memo), len(xs), len(ys), []
    while i and j:
        w = matching(xs[i - 1], ys[j - 1], memo)
        if w and rows[i][j] == rows[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _weights(ys: tuple, memo: dict):
    """Function that gives the matches of a node with all of ``ys``; equal nodes are compared once."""
    kinds: dict = {}
    codes = np.array([kinds.setdefault(y, len(kinds)) for y in ys], np.int64)
    of_label: dict = {}
    for y, k in kinds.items():
        of_label.setdefault(y[0], []).append((y, k))

    def weights(x: tuple) -> np.ndarray:
        found = np.zeros(len(kinds), np.int64)
        for y, k in of_label.get(x[0], ()):
            found[k] = matching(x, y, memo)
        return found[codes]
    return weights


def _next_row(last: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The row of ``_table`` after ``last``."""
    row = np.zeros_like(last)
    np.maximum.accumulate(np.maximum(last[1:], last[:-1] + weights), out=row[1:])
    return row


def _aligned_long(xs: tuple, ys: tuple, memo: dict) -> list:
    """``aligned`` of long lists: the same table, of which every so many rows are kept and the others
    are made again on the way back."""
    weights, step = _weights(ys, memo), math.isqrt(len(xs)) + 1
    row, kept = np.zeros(len(ys) + 1, np.int64), []
    for i, x in enumerate(xs):
        if i % step == 0:
            kept.append(row)
        row = _next_row(row, weights(x))
    i, j, pairs = len(xs), len(ys), []
    for s in range((len(kept) - 1) * step, -1, -step):
        rows, gains = [kept[s // step]], []
        for x in xs[s:i]:
            gains.append(weights(x))
            rows.append(_next_row(rows[-1], gains[-1]))
        while i > s and j:
            w, here = gains[i - 1 - s][j - 1], rows[i - s][j]
            if w and here == rows[i - 1 - s][j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif here == rows[i - 1 - s][j]:
                i -= 1
            else:
                j -= 1
        if not j:
            break
    return pairs[::-1]


def merge(template: tuple, tree: tuple, memo: dict | None = None) -> tuple:
    """The template with the tree's unmatched nodes put in at their places."""
    if template == tree:
        return template
    memo = {} if memo is None else memo
    xs, ys, out, at = template[1], tree[1], [], 0
    last = 0
    for i, j in aligned(xs, ys, memo):
        out += xs[last:i]
        out += ys[at:j]
        out.append(merge(xs[i], ys[j], memo))
        last, at = i + 1, j + 1
    out += xs[last:]
    out += ys[at:]
    return (template[0], tuple(out))


def places(template: tuple, tree: tuple, memo: dict | None = None, first: int = 0, out: list | None = None) -> list:
    """Preorder number in the template of each node of the tree (in preorder), -1 if unmatched."""
    memo = {} if memo is None else memo
    out = [] if out is None else out
    out.append(first)
    starts, n = [], first + 1
    for child in template[1]:
        starts.append(n)
        n += size(child)
    matched = dict((j, i) for i, j in aligned(template[1], tree[1], memo))
    for j, child in enumerate(tree[1]):
        if j in matched:
            places(template[1][matched[j]], child, memo, starts[matched[j]], out)
        else:
            out += [-1] * size(child)
    return out


def number(node: Node, tree: tuple, first: int = 0) -> None:
    """Gives each element its folded node's preorder number in the page's own skeleton."""
    node.place = first
    if node.depth >= MAX_DEPTH:
        todo = list(node.children)
        while todo:
            x = todo.pop()
            x.place = first
            todo += x.children
        return
    starts, n = [], first + 1
    for child in tree[1]:
        starts.append(n)
        n += size(child)
    k = -1
    for child in node.children:
        if k < 0 or tree[1][k][0] != child.label:
            k += 1
        # within a folded row each sibling is placed by matching its own tree
        own = skeleton(child)
        if own == tree[1][k]:
            number(child, own, starts[k])
        else:
            _number_in(child, own, places(tree[1][k], own, None, starts[k]))


def _number_in(node: Node, own: tuple, where: list) -> None:
    number(node, own)
    todo = [node]
    while todo:
        x = todo.pop()
        x.place = where[x.place]
        todo += x.children


def to_list(tree: tuple) -> list:
    return [tree[0], [to_list(c) for c in tree[1]]]


def from_list(tree: list) -> tuple:
    return (tree[0], tuple(from_list(c) for c in tree[1]))
