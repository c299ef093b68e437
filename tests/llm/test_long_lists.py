"""Simple tree matching gives the same match whatever the length of the lists."""

import random

from tessera.llm import dom


def _tree(rng, depth):
    return (rng.choice("abc"), tuple(_tree(rng, depth - 1) for _ in range(rng.randint(0, 5))) if depth else ())


def test_long_lists_are_matched_as_short_ones(monkeypatch):
    rng = random.Random(11)
    pairs = [(_tree(rng, 3), _tree(rng, 3)) for _ in range(300)]
    pairs += [(("r", a[1]), ("r", b[1])) for a, b in pairs]
    want = [(dom.matching(a, b, {}), dom.aligned(a[1], b[1], {})) for a, b in pairs]
    monkeypatch.setattr(dom, "MAX_PAIRS", 0)
    assert [(dom.matching(a, b, {}), dom.aligned(a[1], b[1], {})) for a, b in pairs] == want


def test_a_long_list_is_matched_in_full():
    xs = tuple(("p" if i % 3 else "q", ()) for i in range(300))
    ys = tuple(("q" if i % 7 else "p", ()) for i in range(300))
    rows = dom._table(xs, ys, {})
    assert len(dom.aligned(xs, ys, {})) == rows[-1][-1] == dom.matching(("r", xs), ("r", ys), {}) - 1
