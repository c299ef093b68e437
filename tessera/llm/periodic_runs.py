"""Periodic runs of words, found in a Re-Pair grammar of the word ids."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, utf8

#: words of documents that get one grammar (a longer document has one of its own)
BLOCK_WORDS = 400_000
#: words that one Python worker numbers before it starts anew
WORD_ENTRIES = 600_000
#: shortest run in words
LEAST = 12
#: a run's matching stretch has LEAST - q words or more (q < LEAST) or q or more, so on one side of
#: any place in it there are NEAR (q < LEAST) or FAR words of it
NEAR, FAR = 3, 6
#: candidate periods that are extended at a time
AT_ONCE = 1 << 19
#: multiplier of the prefix hashes (odd; the arithmetic wraps at 2^64)
BASE = np.uint64(0x9E3779B97F4A7C15)


class Grammar:
    """Re-Pair over the ids of several documents laid end to end; pairs never reach over an end.

    A round replaces every pair that is the most frequent one (non-overlapping occurrences) among
    the pairs that overlap it and comes twice or more, so pairs that don't compete go in one
    round and the most frequent pair always goes. Ties are broken by a hash of the pair: in a long
    passage that comes twice about every third pair goes at once. The end is that of Re-Pair:
    no pair comes twice.

    ``start, middle, stop`` are the boundary of every nonterminal in one of its occurrences,
    ``first_use, uses`` where all its derivations begin; the symbols left of a document are
    joined by a balanced tree whose nodes are nonterminals with one occurrence each.
    """

    def __init__(self, ids: np.ndarray, doc_stops: np.ndarray):
        n = len(ids)
        symbols, at = ids.astype(np.int64), np.arange(n)
        last = np.zeros(n, bool)
        last[doc_stops[doc_stops > 0] - 1] = True
        size = np.ones(n, np.int64)
        alive, top = ~last, int(ids.max()) + 1 if n else 0
        self.repeated = None  # which pairs of words come twice or more
        starts, middles, stops, uses, counts = [], [], [], [], []
        while True:
            where = np.flatnonzero(alive)
            if not len(where):
                break
            left, right = symbols[where], symbols[where + 1]
            code, distinct = pd.factorize(left * top + right)
            real = self._apart(where, left == right)
            times = np.bincount(code[real], minlength=len(distinct))
            often = times[code] >= 2
            if self.repeated is None:
                self.repeated = np.zeros(n, bool)
                self.repeated[where[np.bincount(code)[code] >= 2]] = True
            # the pair's precedence at each place, 0 where no pair is to be replaced
            rank = np.zeros(len(symbols) + 2, np.int64)
            use = real & often
            mixed = (distinct.astype(np.uint64) * BASE) >> np.uint64(33)  # odd factor: a bijection before the shift
            tie = np.empty(len(distinct), np.int64)
            tie[np.argsort(mixed, kind="stable")] = np.arange(1, len(distinct) + 1)
            rank[where[use] + 1] = times[code[use]] << 32 | tie[code[use]]
            wins = (rank[where + 1] > rank[where]) & (rank[where + 1] > rank[where + 2])
            won = np.bincount(code[wins], minlength=len(distinct))
            wins &= won[code] >= 2
            chosen = where[wins]
            if not len(chosen):
                break
            names, first, inverse = np.unique(code[wins], return_index=True, return_inverse=True)
            starts.append(at[chosen[first]])
            middles.append(at[chosen[first] + 1])
            stops.append(at[chosen[first] + 1] + size[chosen[first] + 1])
            order = np.argsort(inverse, kind="stable")
            uses.append(at[chosen][order])
            counts.append(np.bincount(inverse))
            alive[where] = often
            symbols[chosen] = top + inverse
            size[chosen] += size[chosen + 1]
            last[chosen] = last[chosen + 1]
            alive[chosen] = True
            alive[chosen[chosen > 0] - 1] = True  # the pair with the symbol before, if that is of the document
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, at, size, last, alive = symbols[keep], at[keep], size[keep], last[keep], alive[keep]
            alive &= ~last
            top += len(names)
        if self.repeated is None:
            self.repeated = np.zeros(n, bool)
        doc = np.searchsorted(doc_stops, at, "right")
        stop = at + size
        while len(at):  # neighbours are joined two by two, level by level
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            pair = np.flatnonzero((place % 2 == 0) & np.append(doc[1:] == doc[:-1], False))
            if not len(pair):
                break
            starts.append(at[pair])
            middles.append(at[pair + 1])
            stops.append(stop[pair + 1])
            uses.append(at[pair])
            counts.append(np.ones(len(pair), np.int64))
            stop[pair] = stop[pair + 1]
            keep = np.ones(len(at), bool)
            keep[pair + 1] = False
            at, stop, doc = at[keep], stop[keep], doc[keep]
        empty = [np.empty(0, np.int64)]
        self.start, self.middle, self.stop, self.uses = (np.concatenate(x or empty) for x in (starts, middles, stops, uses))
        self.first_use = np.concatenate([[0], np.cumsum(np.concatenate(counts or empty))]).astype(np.int64)

    @staticmethod
    def _apart(where: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Occurrences that count: of a symbol's pairs with itself in a row every other one."""
        real = np.ones(len(where), bool)
        twins = np.flatnonzero(same)
        if len(twins):
            begins = np.append(True, np.diff(where[twins]) != 1)
            first = np.maximum.accumulate(np.where(begins, np.arange(len(twins)), 0))
            real[twins] = (np.arange(len(twins)) - first) % 2 == 0
        return real


class _Matches:
    """Longest common extensions of places in an id array, by prefix hashes and bisection.

    Equal stretches always have equal hashes; found runs are compared word by word afterwards.
    """

    def __init__(self, ids: np.ndarray):
        x = ids.astype(np.uint64) + np.uint64(1)  # a scrambled 64-bit number for every id
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), BASE, np.uint64)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(x * self.power[:-1])])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the ``k`` ids from each place on, comparable between places."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        return (self.sums[k:] - self.sums[:n]) * self.power[n - 1::-1][:n]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common ids from ``a`` and from ``b`` > ``a`` on, at most ``most``."""
        return self._bisect(b - a, most, lambda k: (a, a + k))

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common ids before ``a`` and before ``b`` > ``a``, at most ``most``."""
        return self._bisect(b - a, most, lambda k: (a - k, a))

    def _bisect(self, shift, most, stretch) -> np.ndarray:
        low, high, sums = np.zeros(len(most), np.int64), most.copy(), self.sums
        while (low < high).any():
            k = (low + high + 1) // 2
            x, y = stretch(k)
            same = (sums[y] - sums[x]) * self.power[shift] == sums[y + shift] - sums[x + shift]
            low, high = np.where(same, k, low), np.where(same, high, k - 1)
        return low


def _candidates(grammar: Grammar, m: _Matches, doc_of: np.ndarray) -> Iterator[tuple]:
    """``(boundary, q, forward)``: periods that a run over the boundary may have.

    A run over a boundary has a period's words behind it (``forward``) or before it. Words
    that match at distance q then lie around the boundary; NEAR or FAR of them begin or end
    there, and so come again q words further on or back.
    """
    n = len(doc_of)
    start, middle, stop = grammar.start, grammar.middle, grammar.stop
    near, far = m.grams(NEAR), m.grams(FAR)
    # short periods: the grams at distances 1 to LEAST - 1
    ahead, behind = np.zeros(n, bool), np.zeros(n, bool)
    for q in range(1, min(LEAST, len(near))):
        same = near[:-q] == near[q:]
        ahead[:len(same)] |= same
        behind[q:q + len(same)] |= same
    before = np.maximum(middle - NEAR, 0)
    for forward, flags in ((True, ahead), (False, behind)):
        some = np.flatnonzero(flags[middle] | flags[before])
        for q in range(1, LEAST) if len(some) else ():
            b = middle[some]
            ok = b + q <= stop[some] if forward else b - q >= start[some]
            hit = np.zeros(len(some), bool)
            for x in (b, b - NEAR):
                y = x + q if forward else x - q
                good = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(near))
                hit |= good & (near[np.where(good, x, 0)] == near[np.where(good, y, 0)])
            found = some[ok & hit]
            yield found, np.full(len(found), q, np.int64), forward
    # long periods: the places where the same gram comes in the document
    if len(far) < 2:
        return
    twice = grammar.repeated.astype(np.int8)
    held = sum(twice[k:k + len(far)] for k in range(FAR - 1)) == FAR - 1
    held &= doc_of[:len(far)] == doc_of[FAR - 1:]
    places = np.flatnonzero(held)
    if not len(places):
        return
    code = np.full(n, -1, np.int64)
    code[places] = pd.factorize(far[places] ^ (doc_of[places].astype(np.uint64) * BASE))[0]
    listed = np.sort(code[places] * n + places)  # the places of each gram, in order
    for forward in (True, False):
        for back in (0, FAR):
            x = np.maximum(middle - back, 0)
            boundary = np.flatnonzero((middle - back >= start) & (code[np.minimum(x, n - 1)] >= 0))
            x = x[boundary]
            room = stop[boundary] - middle[boundary] if forward else middle[boundary] - start[boundary]
            # places LEAST to room words away
            least, most = (x + LEAST, x + room) if forward else (x - room, x - LEAST)
            lo = np.searchsorted(listed, code[x] * n + np.maximum(least, 0))
            hi = np.searchsorted(listed, code[x] * n + np.clip(most, -1, n - 1), "right")
            many = np.maximum(hi - lo, 0)
            total = np.cumsum(many)
            at = 0
            while at < len(boundary):
                to = max(at + 1, int(np.searchsorted(total, total[at] - many[at] + AT_ONCE, "right")))
                row = np.repeat(np.arange(at, to), many[at:to])
                k = np.arange(len(row)) + (total[at] - many[at]) - (total - many)[row] + lo[row]
                yield boundary[row], np.abs(listed[k] % n - x[row]), forward
                at = to


def _boundary_runs(grammar: Grammar, m: _Matches, doc_of: np.ndarray) -> tuple:
    """Runs over each nonterminal's boundary, within it: ``(boundary, start, stop, q)``."""
    out = []
    for found, q, forward in _candidates(grammar, m, doc_of):
        if not len(found):
            continue
        b, lo, hi = grammar.middle[found], grammar.start[found], grammar.stop[found]
        a, c = (b, b + q) if forward else (b - q, b)  # ids before a match those before c, ids from a on those from c on
        front, back = m.backward(a, c, a - lo), m.forward(a, c, hi - c)
        start, stop = a - front, c + back
        good = stop - start >= np.maximum(LEAST, 2 * q)
        out.append(np.stack([found[good], start[good], stop[good], q[good]]))
    return tuple(np.concatenate(out, axis=1)) if out else (np.empty(0, np.int64),) * 4


def block_runs(ids: np.ndarray, doc_stops: np.ndarray) -> tuple:
    """All runs ``(start, stop, q)`` of documents laid end to end, by start and period.

    Each run lies whole in the lowest node that holds it, and goes over that node's boundary;
    what smaller nodes hold of it overlaps it by a period or more and is merged with it.
    """
    none = (np.empty(0, np.int64),) * 3
    if len(ids) < LEAST:
        return none
    grammar, m = Grammar(ids, doc_stops), _Matches(ids)
    doc_of = np.searchsorted(doc_stops, np.arange(len(ids)), "right")
    found, start, stop, q = _boundary_runs(grammar, m, doc_of)
    if not len(found):
        return none
    _, one = np.unique(np.stack([found, start, q]), axis=1, return_index=True)
    found, start, stop, q = found[one], start[one], stop[one], q[one]
    # to all derivations of the nonterminal
    many = grammar.first_use[found + 1] - grammar.first_use[found]
    row = np.repeat(np.arange(len(found)), many)
    use = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + grammar.first_use[found][row]
    moved = grammar.uses[use] - grammar.start[found][row]
    start, stop, q = start[row] + moved, stop[row] + moved, q[row]
    # maximal intervals of each period
    order = np.lexsort((start, q))
    start, stop, q = start[order], stop[order], q[order]
    group = np.cumsum(np.append(True, q[1:] != q[:-1])) - 1
    wide = len(ids) + 1
    reach = np.maximum.accumulate(group * wide + stop) - group * wide
    new = np.append(True, (group[1:] != group[:-1]) | (start[1:] > reach[:-1] - q[1:]))
    first = np.flatnonzero(new)
    start, q, stop = start[first], q[first], np.maximum.reduceat(stop, first)
    # of the periods of one interval the smallest
    order = np.lexsort((q, stop, start))
    start, stop, q = start[order], stop[order], q[order]
    least = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))
    start, stop, q = start[least], stop[least], q[least]
    if not _hold(ids, doc_stops, start, stop, q):
        raise ArithmeticError("prefix hashes of unequal words agree")
    order = np.lexsort((q, start))
    return start[order], stop[order], q[order]


def _hold(ids, doc_stops, start, stop, q) -> bool:
    """Whether all runs are runs, word by word, and can't be longer."""
    starts = np.concatenate([[0], doc_stops])
    doc = np.searchsorted(doc_stops, start, "right")
    for a, b, p, lo, hi in zip(start.tolist(), stop.tolist(), q.tolist(), starts[doc].tolist(), doc_stops[doc].tolist()):
        if not np.array_equal(ids[a:b - p], ids[a + p:b]) or (a > lo and ids[a - 1] == ids[a - 1 + p]) \
                or (b < hi and ids[b] == ids[b - p]):
            return False
    return True


def runs_by_comparison(ids: np.ndarray) -> list:
    """Runs ``(start, stop, q)`` of one document by comparing it with itself at every distance."""
    best: dict = {}
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]]).astype(np.int8)
        edges = np.diff(same)
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            if b - a + q >= max(LEAST, 2 * q):
                best.setdefault((a, b + q), q)
    return sorted((a, b, q) for (a, b), q in best.items())


def _document_runs(numbered: list) -> list:
    """Runs of each document (an id array), sorted by start, then period."""
    stops = np.cumsum([len(x) for x in numbered]).astype(np.int64)
    ids = np.concatenate(numbered) if numbered else np.empty(0, np.int64)
    try:
        start, stop, q = block_runs(ids, stops)
    except ArithmeticError:
        return [sorted(runs_by_comparison(x), key=lambda r: (r[0], r[2])) for x in numbered]
    out: list = [[] for _ in numbered]
    doc = np.searchsorted(stops, start, "right")
    base = np.concatenate([[0], stops])[doc]
    for d, a, b, p in zip(doc.tolist(), (start - base).tolist(), (stop - base).tolist(), q.tolist()):
        out[d].append((a, b, p))
    return out


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document that repetition is planted in.

    Of ids whose CRC-32 (of their decimal form) is a multiple of 10, all words from place a on
    repeat a period of p words. None: the text stays as it is (also for a null id).
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def _blocks(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[tuple]:
    """``(ids, words, runs)`` of the documents of one grammar after another."""
    number = per_worker(("words",), lambda: [_Numbers()])
    held, size = [], 0

    def done() -> tuple:
        ids, words, numbered = zip(*held)
        return ids, words, _document_runs(list(numbered))

    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            words = raw.split()  # bytes: at space and U+0009 to U+000D
            if size and size + len(words) > BLOCK_WORDS:
                yield done()
                held, size = [], 0
            if not size and len(number[0]) > WORD_ENTRIES:
                number[0] = _Numbers()
            numbered = np.fromiter(map(number[0].__getitem__, words), np.int64, len(words))
            order = planted_order(i, len(words)) if plant else None
            if order is not None:
                numbered, words = numbered[order], [words[k] for k in order.tolist()]
            held.append((i, words, numbered))
            size += len(words)
    if held:
        yield done()


def _collapsed(words: list, runs: list) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for a, b, q in runs:
        drop[a + q] += 1
        drop[b] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()])


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, runs, collapsed)``: each text's runs as ``struct(start, length, period)`` in words, by
    start, then period, and the words left when each run keeps its first period only.

    Null and empty texts have no runs and an empty rest. One row per input row; null ids and
    repeated rows are kept, other columns ignored.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in _blocks(batches, False):
            listed = [[{"start": a, "length": b - a, "period": q} for a, b, q in r] for r in runs]
            rest = [_collapsed(w, r).decode() for w, r in zip(words, runs)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(listed, kind), pa.array(rest, pa.string())],
                                  ["id", "runs", "collapsed"])

    return _read(docs, id_col, text_col).mapInArrow(
        run, "id long, runs array<struct<start:long, length:long, period:long>>, collapsed string")


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of runs, the longest one, digests of all runs and of the collapsed text, per row.

    Repetition is planted first (see ``planted_order``). Of equally long runs the first counts,
    then the one of smaller period; without runs the four figures are null and the list is
    empty. Null, empty and repeated rows as in ``find_runs``.
    """
    names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def row(i, words, runs) -> tuple:
        a, b, q = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=(None, None, None))
        figures = (None,) * 4 if a is None else (a, b - a, q, 1000 * (b - a) // q)
        listed = "".join(f"{x},{y - x},{p}\n" for x, y, p in runs).encode()
        return i, len(runs), *figures, hashlib.sha256(listed).hexdigest(), hashlib.sha256(_collapsed(words, runs)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, True):
            rows = zip(*map(row, *block))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    schema = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names)
    return _read(docs, id_col, text_col).mapInArrow(run, schema)
