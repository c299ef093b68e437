"""Bound-and-prune top-k inside one task: covering balls and a running k-th distance.

The token vectors of an Arrow batch are dealt to a few balls. An article is covered by the balls
that its tokens lie in, each with the smallest and the largest distance of the article's own
tokens from the centre. By the triangle inequality no token of it is nearer to a query token
than these shells are, so the mean over the query's tokens has a lower bound that costs one
comparison per ball instead of one per token. Articles of the smallest bounds are scored
first; after that a pair of article and query whose bound is above the query's k-th
distance so far is never scored.

Where articles share vectors (a token-wise encoder), each distinct vector meets the query tokens once
(``NearRows``): only the pairs nearer than a query token's radius are kept. An article's smallest distance
to a query token is that of a kept pair, or at least the radius, which is a tight bound at the cost
of a few kept pairs per query token instead of a distance per pair of tokens.

The k best per query are kept over all batches of the task and sent once. Bounds are lowered by
more than the rounding of their arithmetic, so results equal those of full scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: balls that the vectors of a batch are dealt to, and vectors that centres are picked from
BALLS, PICKED = 64, 2048
#: bounds by balls must spare this share of the pairs; if they don't, only every PAUSE-th chunk tries them
WORTH, PAUSE = 0.2, 16
#: articles taken at a time
CHUNK = 256
#: vectors of an article that are to be within a query token's radius, on average; vectors that radii are taken
#: from; pairs of a vector and a query token kept at most, and distances computed at once
HITS, SAMPLE, PAIRS, BLOCK = 2.0, 2048, 16 << 20, 1 << 20


class NearRows:
    """The pairs of vectors (rows, numbered as they come) and query tokens whose distance is below the
    token's radius, with distances in single precision lowered by more than all rounding."""

    def __init__(self, Q: np.ndarray):
        self.Q = Q
        self.qq = np.einsum("ij,ij->i", Q, Q)
        self.radius = None
        self.largest, self.most = 0.0, np.abs(Q).max(initial=0.0)
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.column, self.distance = np.empty(0, np.int32), np.empty(0, np.float32)

    def _lowered(self, X: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances of some vectors to all query tokens."""
        xx = np.einsum("ij,ij->i", X, X)
        kind = np.float32 if xx.max(initial=0.0) + self.qq.max(initial=0.0) < 1e36 else np.float64
        # a sum of n products is off by less than n times the rounding of all of them
        left = 1 - 3 * (X.shape[1] + 8) * np.finfo(kind).eps
        with np.errstate(invalid="ignore", over="ignore"):
            out = X.astype(kind) @ (-2.0 * self.Q).astype(kind).T
            out += (xx * left).astype(kind)[:, None]
            out += (self.qq * left).astype(kind)
        return out

    def grow(self, X: np.ndarray, tokens: float) -> None:
        """Takes in the next vectors (micro-units) of articles that have so many ``tokens`` each."""
        if not len(X):
            return
        if self.radius is None:
            some = X[np.linspace(0, len(X) - 1, min(SAMPLE, len(X))).astype(np.int64)]
            place = min(len(some) - 1, int(np.ceil(len(some) * HITS / max(tokens, 1.0))))
            step = max(1, BLOCK // len(some))
            radius = [np.partition(NearRows(self.Q[c:c + step])._lowered(some), place, axis=0)[place] for c in range(0, len(self.Q), step)]
            radius = np.maximum(np.nan_to_num(np.concatenate(radius).astype(np.float64), nan=0.0, posinf=0.0), 0)
            self.radius = np.minimum(np.sqrt(radius), 1e38).astype(np.float32)
        columns, distances, lengths = [self.column], [self.distance], [self.length]
        held, step = len(self.column), max(1, BLOCK // len(self.Q))
        self.most = np.maximum(self.most, np.abs(X).max())  # NaN stays
        self.largest = np.maximum(self.largest, np.einsum("ij,ij->i", X, X).max())
        for a in range(0, len(X), step):
            low = self._lowered(X[a:a + step])
            row, column = np.nonzero(low < np.square(self.radius, dtype=np.float64).astype(low.dtype))
            distances.append(np.sqrt(np.maximum(low[row, column], 0)).astype(np.float32))
            columns.append(column.astype(np.int32))
            lengths.append(np.bincount(row, minlength=len(low)))
            held += len(row)
            if held > PAIRS:
                columns, distances, lengths = self._nearer(*map(np.concatenate, (columns, distances, lengths)))
                held = len(columns[0])
        self.column, self.distance, self.length = map(np.concatenate, (columns, distances, lengths))
        self.start = np.cumsum(self.length) - self.length

    def _nearer(self, column: np.ndarray, distance: np.ndarray, length: np.ndarray) -> tuple:
        """Smaller radii, until half of the pairs that may be kept are left."""
        row = np.repeat(np.arange(len(length)), length)
        for factor in (0.95, 0.9, 0.8, 0.5, 0.0):
            self.radius = (self.radius * np.float32(factor)).astype(np.float32)
            left = distance < self.radius[column]
            row, column, distance = row[left], column[left], distance[left]
            if len(column) <= PAIRS // 2:
                break
        return [column], [distance], [np.bincount(row, minlength=len(length))]

    @property
    def exact(self) -> bool:
        """Whether squared distances of the vectors are exact in double precision, in whatever order they are summed."""
        return 4.0 * self.most * self.most * self.Q.shape[1] < 2.0 ** 53

    def nearest(self, rows: np.ndarray, X) -> np.ndarray:
        """Smallest squared distance of one article's vectors (``rows`` of ``X``) to every query token, exactly;
        infinite where it may be that of a pair that is not kept. Needs ``exact``."""
        out = np.full(len(self.Q), np.inf)
        lengths = self.length[rows]
        if not lengths.any():
            return out
        places = _places(self.start[rows], lengths)
        column, square = self.column[places], np.square(self.distance[places], dtype=np.float64)
        least = np.full(len(self.Q), np.inf)
        np.minimum.at(least, column, square)
        # the kept squares are lowered by at most twice the bound of the rounding
        above = least * (1 + 1e-6) + 7 * (self.Q.shape[1] + 8) * np.finfo(np.float32).eps * (self.largest + self.qq)
        near = np.flatnonzero(square <= above[column])
        column, row = column[near], np.repeat(rows, lengths)[near]
        sure = (above < np.square(self.radius, dtype=np.float64) * (1 - 1e-6))[column]
        column, row = column[sure], row[sure]
        if len(row):
            vectors, place = np.unique(row, return_inverse=True)
            away = X[vectors][place.reshape(-1)] - self.Q[column]
            np.minimum.at(out, column, np.einsum("ij,ij->i", away, away))
        return out

    def minima(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Lower bound of the smallest distance of every article (with ``counts`` vectors each, in turn) to
        every query token."""
        n, width = len(counts), len(self.Q)
        out = np.empty((n, width), np.float32)
        out[:] = self.radius
        lengths = self.length[rows]
        if lengths.any():
            cell = np.repeat(np.repeat(np.arange(0, n * width, width), counts), lengths)
            places = _places(self.start[rows], lengths)
            cell += self.column[places]
            np.minimum.at(out.reshape(-1), cell, self.distance[places])
        return out


class RunningTopK:
    """The ``k`` best articles of every query among those of a task so far.

    ``scored`` and ``seen`` count pairs of article and query, ``scored_articles`` and
    ``seen_articles`` articles.
    """

    def __init__(self, payload: dict, k: int, tile: int, cells: int, sq_dist, micro: float, pico: float, minima: bool = False):
        n = len(payload["query_ids"])
        self.payload, self.k, self.tile, self.cells = payload, k, tile, cells
        self.sq_dist, self.micro, self.pico = sq_dist, micro, pico
        self.dist, self.ids, self.real = np.full((n, k), np.inf), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        self.scored = self.seen = self.scored_articles = self.seen_articles = self.chunks = 0
        self.tried = self.worth = False
        ends = np.append(payload["starts"][1:], len(payload["inv"]))
        self.spans = list(zip(payload["starts"], ends))
        self.columns = [payload["inv"][a:b] for a, b in self.spans]
        # of the best articles, the distances of the query's tokens too
        self.parts = [np.empty((0, len(c))) for c in self.columns] if minima else None

    @property
    def limit(self) -> np.ndarray:
        """Distance above which an article can't be among a query's best."""
        return np.where(self.real[:, -1], self.dist[:, -1], np.inf)

    def rows(self) -> pa.RecordBatch:
        query, place = np.nonzero(self.real)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.payload["query_ids"][query], pa.int64()), pa.array(self.ids[query, place], pa.int64()),
             pa.array(self.dist[query, place], pa.float64())], names=["query_id", "article_id", "distance"])

    def minima(self) -> pa.RecordBatch:
        """``(query_id, tok_no, article_id, p)`` of the best articles."""
        p, found = self.payload, [int(r.sum()) for r in self.real]
        at = np.concatenate([np.tile(np.arange(a, b), n) for (a, b), n in zip(self.spans, found)])
        ids = np.concatenate([np.repeat(i[:n], b - a) for (a, b), n, i in zip(self.spans, found, self.ids)])
        pico = np.concatenate([x.reshape(-1) for x in self.parts])
        return pa.RecordBatch.from_arrays(
            [pa.array(p["tok_query"][at], pa.int64()), pa.array(p["tok_no"][at], pa.int64()), pa.array(ids, pa.int64()),
             pa.array(pico.astype(np.int64), pa.int64())], names=["query_id", "tok_no", "article_id", "p"])

    def _offer(self, query: int, ids: np.ndarray, dist: np.ndarray, parts: np.ndarray) -> None:
        """Takes what belongs to a query's best: smaller distance, then later id."""
        near = np.flatnonzero(~(dist > self.limit[query]))
        if not len(near):
            return
        held = int(self.real[query].sum())
        ids, dist = np.append(self.ids[query][:held], ids[near]), np.append(self.dist[query][:held], dist[near])
        place = np.append(np.arange(held), held + near)
        if len(ids) > 4 * self.k:  # a partition by the k-th distance first
            edge = np.partition(dist, self.k - 1)[self.k - 1]
            few = ~(dist > edge)
            ids, dist, place = ids[few], dist[few], place[few]
        best = np.lexsort((-ids, dist))[:self.k]
        m = len(best)
        self.ids[query, :m], self.dist[query, :m], self.real[query, :m] = ids[best], dist[best], True
        if self.parts is not None:
            place = place[best]
            kept = np.empty((m, parts.shape[1]))
            kept[place < held] = self.parts[query][place[place < held]]
            kept[place >= held] = parts[place[place >= held] - held]
            self.parts[query] = kept

    # -- bounds

    def _balls(self, X: np.ndarray) -> tuple:
        """Centres among the vectors of a batch, each vector's ball and its distance from the centre."""
        centres = _spread_out(X, self.sq_dist)
        d, rest = self.sq_dist(X, centres)
        d = np.maximum(d + rest[None, :], 0)
        ball = d.argmin(axis=1)
        return centres, ball, np.sqrt(d[np.arange(len(X)), ball])

    def _bounds(self, balls: tuple, row_of: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Lower bound of the distance of every article (rows) to every query (columns)."""
        n = len(counts)
        centres, ball, away = balls
        owner = np.repeat(np.arange(n), counts)
        code = owner * len(centres) + ball[row_of]
        inner, outer = np.full(n * len(centres), np.inf), np.full(n * len(centres), -1.0)
        np.minimum.at(inner, code, away[row_of])
        np.maximum.at(outer, code, away[row_of])
        shell = np.flatnonzero(outer != -1.0)  # (article, ball) in article order; NaN stays in
        first = np.searchsorted(shell // len(centres), np.arange(n))
        Q = self.payload["Qu"]
        d, rest = self.sq_dist(centres, Q)
        to_query = np.sqrt(np.maximum(d + rest[None, :], 0))
        out = np.empty((n, len(self.columns)))
        step = max(1, self.tile // max(1, Q.shape[0]))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(first, first[a] + step)))
            part = shell[first[a]:(first[b] if b < n else len(shell))]
            centre = to_query[part % len(centres)]
            gap = np.maximum(centre - outer[part][:, None], inner[part][:, None] - centre)
            least = np.minimum.reduceat(np.maximum(gap, 0), first[a:b] - first[a], axis=0)
            out[a:b] = self._lowered_mean(least, 1e-12)
            a = b
        return out

    # -- scoring

    def add(self, ids: np.ndarray, X, row_of: np.ndarray, counts: np.ndarray, index: NearRows | None = None) -> None:
        """Articles ``ids`` with ``counts`` tokens each (in turn), a token being a row of ``X``
        (micro-units), whose ``index`` may be given. Without one, articles are taken ``CHUNK`` at a time,
        so that the limits fall and the worth of bounds is known early."""
        starts = np.append(0, np.cumsum(counts)[:-1]).astype(np.int64)
        if index is None and len(X) < len(row_of):  # vectors that articles share
            index = NearRows(self.payload["Qu"])
            index.grow(X, len(row_of) / len(counts))
        if index is not None:
            self._add_indexed(ids, X, row_of, starts, counts, index)
            return
        balls = None
        for a in range(0, len(ids), CHUNK):
            some = np.arange(a, min(a + CHUNK, len(ids)))
            tokens = row_of[starts[a]:starts[some[-1]] + counts[some[-1]]]
            self.seen += len(some) * len(self.columns)
            self.seen_articles += len(some)
            self.chunks += 1
            bounds = np.zeros((len(some), len(self.columns)))
            if self.chunks > 1 and (self.worth or not self.tried or self.chunks % PAUSE == 0):
                balls = balls or self._balls(X)
                bounds = self._bounds(balls, tokens, counts[some])
                self.tried, self.worth = True, (bounds > self.limit[None, :]).mean() >= WORTH
            if self.chunks == 1 or not self.worth or len(some) <= self.k:
                self._score_all(some, ids, X, row_of, starts, counts)
                continue
            self._score_bounded(some, bounds, ids, X, row_of, starts, counts)

    def _add_indexed(self, ids, X, row_of, starts, counts, index: NearRows) -> None:
        """Bounds of all articles first, then the nearest by them are scored."""
        bounds = np.empty((len(ids), len(self.columns)))
        stops = starts + counts
        for some in _slices(counts + len(self.payload["Qu"]) // 32, self.tile // 64):  # of their kept pairs, too
            tokens = row_of[starts[some.start]:stops[some.stop - 1]]
            bounds[some] = self._lowered_mean(index.minima(tokens, counts[some]), 2e-7)
        self.seen += bounds.size
        self.seen_articles += len(ids)
        self.chunks += 1
        self._score_bounded(np.arange(len(ids)), bounds, ids, X, row_of, starts, counts, index)

    def _score_nearest(self, pairs: np.ndarray, ids, X, row_of, starts, counts, index: NearRows | None) -> np.ndarray:
        """Scores marked pairs all of whose distances are those of kept pairs, an article at a time; returns the others."""
        if index is None or not index.exact:
            return pairs
        p, found, left = self.payload, [], np.flatnonzero(pairs.any(axis=1))
        for article in left.tolist():
            least = index.nearest(row_of[starts[article]:starts[article] + counts[article]], X)
            found.append(np.floor(np.sqrt(np.maximum(least, 0)) * self.micro + 0.5))
            if len(found) * len(least) >= self.tile // 4 or article == left[-1]:
                chosen, whole = left[:len(found)], np.stack(found)[:, p["inv"]]
                left, found = left[len(found):], []
                mean = np.add.reduceat(whole, p["starts"], axis=1) / p["counts"] / self.pico
                good = pairs[chosen] & np.isfinite(mean)
                pairs[chosen] &= ~good
                self.scored += int(good.sum())
                for query in np.flatnonzero(good.any(axis=0)):
                    mine, (a, b) = good[:, query], self.spans[query]
                    self._offer(query, ids[chosen][mine], mean[mine, query], whole[mine, a:b])
        return pairs

    def _score_bounded(self, some, bounds, ids, X, row_of, starts, counts, index=None) -> None:
        """Scores the articles of each query's smallest bounds, then those that the limits leave."""
        open_ = ~(bounds > self.limit[None, :])
        first = np.zeros_like(open_)
        k = min(self.k, len(some))
        np.put_along_axis(first, np.argpartition(bounds, k - 1, axis=0)[:k], True, axis=0)
        done = first & open_
        marked = np.zeros((len(ids), len(self.columns)), bool)
        marked[some] = done
        self._score(self._score_nearest(marked, ids, X, row_of, starts, counts, index), ids, X, row_of, starts, counts)
        more = open_ & ~first & ~(bounds > self.limit[None, :])
        marked[some] = more
        self._score(self._score_nearest(marked, ids, X, row_of, starts, counts, index), ids, X, row_of, starts, counts)
        self.scored_articles += int((done | more).any(axis=1).sum())

    def _lowered_mean(self, least: np.ndarray, relative: float) -> np.ndarray:
        """Mean over each query's tokens (micro-units in, distances out), lowered by more than all rounding."""
        sums = np.add.reduceat(least[:, self.payload["inv"]], self.payload["starts"], axis=1, dtype=np.float64)
        return np.maximum(sums / self.payload["counts"] * (1 - relative) - 1.0, 0) / self.micro

    def _score(self, pairs: np.ndarray, ids, X, row_of, starts, counts) -> None:
        """Scores the marked pairs: all queries of an article at once where most are marked, else query by query."""
        articles = np.flatnonzero(pairs.any(axis=1))
        if not len(articles):
            return
        if pairs[articles].mean() > 0.5:
            self._score_all(articles, ids, X, row_of, starts, counts, pairs)
            return
        self.scored += int(pairs.sum())
        for query in np.flatnonzero(pairs.any(axis=0)):
            columns, mine = self.columns[query], np.flatnonzero(pairs[:, query])
            for some in _slices(counts[mine], max(1, self.tile // len(columns))):
                chosen = mine[some]
                tokens = row_of[_places(starts[chosen], counts[chosen])]
                if len(X) < len(tokens):  # shared vectors once
                    used = np.zeros(len(X), bool)
                    used[tokens] = True
                    G, rest = self.sq_dist(X[used], self.payload["Qu"][columns])
                    G = G[(np.cumsum(used) - 1)[tokens]]
                else:
                    G, rest = self.sq_dist(X[tokens], self.payload["Qu"][columns])
                mins = np.minimum.reduceat(G, np.cumsum(counts[chosen]) - counts[chosen], axis=0) + rest[None, :]
                dist = np.floor(np.sqrt(np.maximum(mins, 0)) * self.micro + 0.5)
                self._offer(query, ids[chosen], dist.sum(axis=1) / len(columns) / self.pico, dist)

    def _score_all(self, articles, ids, X, row_of, starts, counts, pairs=None) -> None:
        """Scores some articles for all queries, a bounded tile at a time; only marked pairs are
        offered (the others were, or will be, on their own)."""
        p = self.payload
        self.scored += len(articles) * len(self.columns)
        if pairs is None:
            self.scored_articles += len(articles)
        for some in _slices(counts[articles], max(1, self.tile // max(1, p["Qu"].shape[0]))):
            chosen = articles[some]
            G, rest = self.sq_dist(X[row_of[_places(starts[chosen], counts[chosen])]], p["Qu"])
            mins = np.minimum.reduceat(G, np.cumsum(counts[chosen]) - counts[chosen], axis=0) + rest[None, :]
            dist = np.floor(np.sqrt(np.maximum(mins, 0)) * self.micro + 0.5)[:, p["inv"]]
            mean = np.add.reduceat(dist, p["starts"], axis=1) / p["counts"][None, :] / self.pico
            good = ~(mean > self.limit[None, :])
            if pairs is not None:
                good &= pairs[chosen]
            for query in np.flatnonzero(good.any(axis=0)):
                mine, (a, b) = good[:, query], self.spans[query]
                self._offer(query, ids[chosen][mine], mean[mine, query], dist[mine, a:b])


def _spread_out(X: np.ndarray, sq_dist) -> np.ndarray:
    """Centres among the vectors, each as far as can be from those before it."""
    some = X[np.linspace(0, len(X) - 1, min(PICKED, len(X))).astype(np.int64)]
    chosen = [0]
    near = np.full(len(some), np.inf)
    while len(chosen) < min(BALLS, len(some)):
        G, rest = sq_dist(some, some[chosen[-1:]])
        near = np.fmin(near, G[:, 0] + rest[0])
        far = int(np.nanargmax(near)) if not np.isnan(near).all() else 0
        if not near[far] > 0:
            break
        chosen.append(far)
    return some[chosen]


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them), one after the other."""
    total = np.cumsum(counts)
    return np.arange(int(total[-1])) + np.repeat(starts - (total - counts), counts)


def _slices(counts: np.ndarray, most: int):
    """Slices of articles with at most ``most`` tokens together (one article at least)."""
    total, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b
