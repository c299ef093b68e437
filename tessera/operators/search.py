"""Multi-vector nearest search: distance of every article to every query, exact top-k.

Score of an article for a query = mean over the query's (distinct) token vectors of the
smallest Euclidean distance to any of the article's token vectors. Components are taken
to 6 decimal places (the reference rounds them so), which lets the kernel work on integer
micro-units: squared distances are then exact integers whatever the summation order, so
Spark, numpy and an SQL oracle agree bit for bit.

Physical plan: the article side is never shuffled before scoring. Arrow batches of
articles meet the broadcast query matrix in numpy; each task keeps its own k best per query
over all its batches, skips pairs that a lower bound rules out (``pruning``), and sends the k
best once; a window top-k finishes the job after a shuffle on ``query_id`` that carries at
most ``k`` rows per task and query.
"""

from __future__ import annotations

import math
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import MICRO, round_half_away
from .pruning import NearRows, RunningTopK

DIST_SCHEMA = "query_id long, article_id long, distance double"
TOKEN_SCHEMA = ("query_id long, tok_no long, article_id long, nearest_pos int, "
                "min_distance double")

PICO = 1e12  # per-token distances are summed as integer pico-units

# budget of the broadcast query matrix (float64 micro-units) per block
DEFAULT_QUERY_BLOCK_BYTES = 64 * 1024 * 1024
# cap of the (article tokens x query tokens) distance tile held at once in a task
TILE_ELEMENTS = 1024 * 1024
# cap of the (articles x query tokens) result matrices of one kernel call
BATCH_CELLS = 8 * 1024 * 1024
# articles of token ids in one kernel call, and token ids encoded at once
ID_ARTICLES, NEW_ROWS = 1024, 8192
# model vectors taken together, and bytes of different ones that a worker remembers
MODEL_VECTORS, MET_BYTES = 64 * 1024, 64 * 1024 * 1024


def _to_micro(x: np.ndarray) -> np.ndarray:
    """round(x * 1e6) half away from zero, as float64 holding integers."""
    y = x.astype(np.float64)
    y *= MICRO
    r = np.abs(y)
    r += 0.5
    np.floor(r, out=r)
    return np.copysign(r, y, out=r)


def _query_payload(block: pa.Table) -> dict:
    """Query matrix of one block, sorted by (query_id, tok_no)."""
    block = block.sort_by([("query_id", "ascending"), ("tok_no", "ascending")])
    qid = block.column("query_id").to_numpy()
    vec = block.column("vec").combine_chunks()
    lengths = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths.min() != lengths.max()):
        raise ValueError("query vectors differ in length")
    dim = int(lengths[0]) if len(lengths) else 0
    values = vec.flatten().to_numpy(zero_copy_only=False)
    Q = _to_micro(values.reshape(-1, dim)) if dim else np.zeros((0, 0))
    change = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]]) if len(qid) else np.array([], dtype=np.int64)
    counts = np.diff(np.r_[change, len(qid)])
    return {"Q": Q, "query_ids": qid[change] if len(qid) else qid, "starts": change, "counts": counts,
            "dim": dim, "tok_query": qid, "tok_no": block.column("tok_no").to_numpy()}


def _article_matrix(vecs: pa.Array, dim: int):
    """Flatten a list<list<float>> column to (tokens x dim) micro-units plus token counts."""
    counts = pc.fill_null(pc.list_value_length(vecs), 0).to_numpy(zero_copy_only=False)
    flat = vecs.flatten()  # one entry per token (respects slicing)
    if len(flat) == 0:
        return np.zeros((0, dim)), counts
    inner = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
    if inner.min() != dim or inner.max() != dim:
        raise ValueError(f"article vectors must have {dim} components")
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return _to_micro(values.reshape(-1, dim)), counts


def _partial_sq_dist(X: np.ndarray, Q: np.ndarray) -> np.ndarray:
    """``(G, rest)``: (tokens x query tokens) squared distances are ``G + rest``.

    ``rest`` (``|q|^2``, constant per column) is added after the minimum. Exact on integer
    micro-units while every partial sum stays below 2^53; beyond that the differences are
    formed first (int64 while it cannot overflow), ``G`` is the squared distance itself and
    ``rest`` is zero, so that near matches stay exact.
    """
    maxabs = max(float(np.abs(X).max(initial=0.0)), float(np.abs(Q).max(initial=0.0)))
    dim = Q.shape[1]
    if 4.0 * maxabs * maxabs * dim < 2.0 ** 53:
        G = X @ Q.T
        G *= -2.0
        G += np.einsum("ij,ij->i", X, X)[:, None]
        return G, np.einsum("ij,ij->i", Q, Q)
    G = np.empty((X.shape[0], Q.shape[0]), dtype=np.float64)
    step = max(1, TILE_ELEMENTS // max(1, Q.shape[0] * dim))
    exact_int = 4.0 * maxabs * maxabs * dim < 2.0 ** 62
    Xs, Qs = (X.astype(np.int64), Q.astype(np.int64)) if exact_int else (X, Q)
    for s in range(0, X.shape[0], step):
        diff = Xs[s:s + step, None, :] - Qs[None, :, :]
        G[s:s + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return G, np.zeros(Q.shape[0])


def _encoded_matrix(tok_ids: pa.Array, gather, dim: int):
    """Token id lists -> distinct ids' vectors in micro-units, each token's row, counts.

    A token-wise encoder gives equal vectors to equal ids, so each distinct id of the batch
    is encoded (and later scored) once.
    """
    counts = pc.fill_null(pc.list_value_length(tok_ids), 0).to_numpy(zero_copy_only=False)
    flat = tok_ids.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == 0:
        return np.zeros((0, dim)), np.zeros(0, dtype=np.int64), counts
    uniq, inv = np.unique(flat, return_inverse=True)
    V = gather(uniq)
    if V.shape[1] != dim:
        raise ValueError(f"encoder vectors must have {dim} components")
    return _to_micro(V), np.asarray(inv).reshape(-1), counts


def _distinct_tokens(row_of: np.ndarray, counts: np.ndarray, n: int) -> tuple:
    """Each article's distinct vectors only (rows of ``n``): a repeated one changes no minimum."""
    code = np.repeat(np.arange(len(counts)), counts) * n + row_of
    code.sort()
    code = code[np.append(True, code[1:] != code[:-1])] if len(code) else code
    article = code // n
    return code - article * n, np.bincount(article, minlength=len(counts))


class _EncodedRows:
    """The vectors of the token ids that a worker has met, as rows of a matrix in micro-units that is
    made where it is read, and their index. A token-wise encoder gives equal vectors to equal ids."""

    def __init__(self, payload: dict):
        self.dim, self.index = payload["dim"], NearRows(payload["Qu"])
        self.row, self.ids, self.gather = np.empty(0, np.int32), np.empty(0, np.int64), None

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return _to_micro(self.gather(self.ids[rows]))

    def rows_of(self, ids: np.ndarray, articles: int) -> np.ndarray:
        """Row of each of the token ids of so many articles."""
        more = int(ids.max(initial=-1)) + 1 - len(self.row)
        if more > 0:
            self.row = np.append(self.row, np.full(more, -1, np.int32))
        new = np.unique(ids[self.row[ids] < 0])
        for s in range(0, len(new), NEW_ROWS):
            part = new[s:s + NEW_ROWS]
            V = self.gather(part)
            if V.shape[1] != self.dim:
                raise ValueError(f"encoder vectors must have {self.dim} components")
            self.index.grow(_to_micro(V), len(ids) / articles)
            self.row[part] = np.arange(len(self.ids), len(self.ids) + len(part))
            self.ids = np.append(self.ids, part)
        return self.row[ids].astype(np.int64)


_MET: dict = {}  # by a query block's key, what a worker has met; tasks run one after another in it


def _met(payload: dict, make):
    if (key := payload.get("key")) is None:
        return make(payload)
    if key not in _MET:
        _MET.clear()  # of one block at a time
        _MET[key] = make(payload)
    return _MET[key]


def _add_batch(best: RunningTopK, ids: np.ndarray, vecs: pa.Array, gather=None) -> None:
    """One Arrow batch of articles into a task's running top-k."""
    index = None
    if gather is None:
        X, counts = _article_matrix(vecs, best.payload["dim"])
        row_of = np.arange(len(X))
    else:
        counts = pc.fill_null(pc.list_value_length(vecs), 0).to_numpy(zero_copy_only=False)
        flat = vecs.flatten().to_numpy(zero_copy_only=False)
        if not len(flat):
            return
        X = _met(best.payload, _EncodedRows)
        X.gather, index = gather, X.index
        row_of, counts = _distinct_tokens(X.rows_of(flat, len(counts)), counts, len(X))
    keep = counts > 0  # an article without tokens has no distance
    if keep.any():
        best.add(ids[keep], X, row_of, counts[keep], index)


def _score_batch(ids: np.ndarray, vecs: pa.Array, qp: dict, mode: str = "mean", gather=None, cells_cap: int = BATCH_CELLS):
    # identical query token vectors (a word shared by many queries) are scored once
    Q = qp["Qu"]
    rows_of = None  # token -> row of the distinct-vector matrix (token-wise encoders)
    if gather is None:
        X, counts = _article_matrix(vecs, qp["dim"])
    else:  # token ids: the encoder runs here, its vectors never leave the task
        X, rows_of, counts = _encoded_matrix(vecs, gather, qp["dim"])
    keep = counts > 0  # an article without tokens has no distance
    if not keep.all():
        if rows_of is None:
            X = X[np.repeat(keep, counts)]
        else:
            rows_of = rows_of[np.repeat(keep, counts)]
    ids, counts = ids[keep], counts[keep]
    if len(ids) == 0 or Q.shape[0] == 0:
        return None
    # distinct vectors are scored once and tiles gather their rows, while that matrix stays
    # small; otherwise every token row is scored in tiles as for given vectors
    G_all = None
    if rows_of is not None:
        if X.shape[0] * Q.shape[0] <= cells_cap:
            G_all, rest = _partial_sq_dist(X, Q)
        else:
            X = X[rows_of]
    tok_starts = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
    # tile over articles so that (tokens x query tokens) stays bounded
    per_tile = max(1, TILE_ELEMENTS // max(1, Q.shape[0]))
    mins = np.empty((len(ids), Q.shape[0]), dtype=np.float64)
    argpos = np.empty((len(ids), Q.shape[0]), dtype=np.int64) if mode == "tokens" else None
    a0 = 0
    while a0 < len(ids):
        a1, tok = a0, 0
        while a1 < len(ids) and (a1 == a0 or tok + counts[a1] <= per_tile):
            tok += counts[a1]
            a1 += 1
        t0 = tok_starts[a0]
        starts = tok_starts[a0:a1] - t0
        if G_all is not None:
            G = G_all[rows_of[t0:t0 + tok]]
        else:
            G, rest = _partial_sq_dist(X[t0:t0 + tok], Q)
        m = np.minimum.reduceat(G, starts, axis=0)
        mins[a0:a1] = m + rest[None, :]
        if argpos is not None:  # first token position reaching the minimum
            owner = np.repeat(np.arange(a1 - a0), counts[a0:a1])
            idx = np.where(G == m[owner], np.arange(tok)[:, None], tok)
            argpos[a0:a1] = np.minimum.reduceat(idx, starts, axis=0) - starts[:, None]
        a0 = a1
    np.maximum(mins, 0.0, out=mins)
    # per-token distances as integer pico-units: sums are exact, so the mean (and every tie)
    # is the same whatever the summation order or engine
    dist_tok = np.floor(np.sqrt(mins) * MICRO + 0.5)[:, qp["inv"]]
    if argpos is not None:
        argpos = argpos[:, qp["inv"]]
    if mode == "tokens":
        na, nt = dist_tok.shape
        rows = np.repeat(np.arange(na), nt)
        cols = np.tile(np.arange(nt), na)
        return pa.RecordBatch.from_arrays(
            [pa.array(qp["tok_query"][cols], pa.int64()), pa.array(qp["tok_no"][cols], pa.int64()),
             pa.array(ids[rows], pa.int64()), pa.array(argpos[rows, cols].astype(np.int32), pa.int32()),
             pa.array(dist_tok[rows, cols] / PICO, pa.float64())],
            names=["query_id", "tok_no", "article_id", "nearest_pos", "min_distance"])
    mean = (np.add.reduceat(dist_tok, qp["starts"], axis=1) / qp["counts"][None, :]) / PICO
    nq = mean.shape[1]
    rows = np.repeat(np.arange(len(ids)), nq)
    cols = np.tile(np.arange(nq), len(ids))
    return pa.RecordBatch.from_arrays(
        [pa.array(qp["query_ids"][cols], pa.int64()), pa.array(ids[rows], pa.int64()),
         pa.array(mean[rows, cols], pa.float64())],
        names=["query_id", "article_id", "distance"])


def query_blocks(queries: DataFrame, max_block_bytes: int) -> list[tuple[str, DataFrame]]:
    """Split the query table so each broadcast block stays under ``max_block_bytes``: the blocks
    with names that depend on the queries only.

    The size is measured, not assumed: token count times vector length. Beyond the budget,
    whole queries are hashed into blocks of half the budget on average; one query (a few
    hundred vectors at most) is small against a block, so hash blocks stay close to their
    mean and well under the budget.
    """
    stats = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"),
                        F.count_distinct("query_id").alias("queries")).first()
    n, dim = int(stats["n"] or 0), int(stats["dim"] or 0)
    size = n * max(dim, 1) * 8
    if size <= max_block_bytes:
        return [("0-of-1", queries)]
    blocks = max(2, min(math.ceil(2 * size / max_block_bytes), 2 * int(stats["queries"])))
    # whole queries per block (a query never spans blocks: its mean needs all its tokens)
    keyed = written(queries.withColumn("_blk", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
    filled = sorted(r["_blk"] for r in keyed.select("_blk").distinct().collect())
    return [(f"{b}-of-{blocks}", keyed.filter(F.col("_blk") == b).drop("_blk")) for b in filled]


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back (cuts lineage, so
    several passes over it do not redo the work upstream)."""
    from ..session import scratch_path
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_block(block: DataFrame):
    """Broadcast of one query block's matrix (distinct vectors once); None without queries."""
    table = block.select(F.col("query_id").cast("long"), F.col("tok_no").cast("long"), F.col("vec")).toArrow()
    if table.num_rows == 0:
        return None
    qp = _query_payload(table)
    if qp["Q"].size:
        Qu, inv = np.unique(qp["Q"], axis=0, return_inverse=True)
    else:
        Qu, inv = qp["Q"], np.zeros(0, dtype=np.int64)
    qp["Qu"], qp["inv"], qp["key"] = Qu, np.asarray(inv).reshape(-1), uuid.uuid4().hex
    return block.sparkSession.sparkContext.broadcast(qp)


def _passes(source: DataFrame, queries: DataFrame, max_block_bytes: int, schema: str, make_kernel, tag: str, dealt=None) -> DataFrame:
    """``source`` through ``make_kernel(broadcast query block)``, one block after another.

    A single block is scored lazily. Of several, each is collected and broadcast alone, its pass
    written to the shared folder and the broadcast destroyed before the next block is fetched,
    so the driver and the executors hold one block at a time; the source is written once.
    ``dealt`` deals the source's rows to the tasks of a pass.
    """
    blocks = query_blocks(queries, max_block_bytes)
    out = None
    if len(blocks) > 1:
        source = written(source, tag)
    for _, block in blocks:
        bc = broadcast_block(block)
        if bc is None:
            continue
        scored = (source if dealt is None else dealt(source)).mapInArrow(make_kernel(bc), schema)
        if len(blocks) > 1:
            scored = written(scored, "scored")
            bc.destroy()
        out = scored if out is None else out.unionByName(scored)
    return source.sparkSession.createDataFrame([], schema) if out is None else out


def article_query_distances(articles: DataFrame, queries: DataFrame, k: int | None = None,
                            id_col: str = "article_id", vecs_col: str = "vecs", mode: str = "mean",
                            max_block_bytes: int = DEFAULT_QUERY_BLOCK_BYTES, encoder=None,
                            counters: tuple | None = None) -> DataFrame:
    """``(query_id, article_id, distance)``: mean over query tokens of the nearest article token.

    ``articles``: one row per article, ``vecs`` = ``array<array<float>>`` (one vector per token);
    or, with a token-wise ``encoder`` (``gather_fn()``), ``vecs_col`` holds token ids and the
    encoder runs inside the scoring task (vectors never travel through the JVM).
    ``queries``: long table ``(query_id, tok_no, vec)``, one row per distinct query token.
    With ``k``, each task keeps its ``k`` best per query over all its batches, by (distance,
    later id first), scores no pair whose lower bound is above them (``pruning``) and sends them
    once; ``counters`` (accumulators of pairs scored and seen) then tell how much was spared.
    """
    art = articles.select(F.col(id_col).cast("long").alias("article_id"), F.col(vecs_col).alias("vecs"))
    gather = encoder.gather_fn() if encoder is not None else None

    def make_kernel(bc):
        return topk_kernel(bc, k, gather, counters) if k is not None and mode == "mean" else all_pairs(bc)

    def all_pairs(bc):
        def kernel(batches, bc=bc, mode=mode, gather=gather, cap=BATCH_CELLS):
            payload = bc.value
            # articles per call so that (articles x query tokens) matrices stay bounded
            step = max(1, cap // max(1, len(payload["inv"])))
            for big in batches:
                for s0 in range(0, big.num_rows, step):
                    rb = big.slice(s0, step)
                    out = _score_batch(rb.column(0).to_numpy(zero_copy_only=False), rb.column(1), payload, mode, gather, cap)
                    if out is not None:
                        yield out
        return kernel

    schema = TOKEN_SCHEMA if mode == "tokens" else DIST_SCHEMA
    return _passes(art, queries, max_block_bytes, schema, make_kernel, "articles")


def topk_kernel(bc, k: int, gather=None, counters=None):
    """A task's ``k`` best articles per query of the broadcast block, sent once at its end."""
    def kernel(batches, tile=TILE_ELEMENTS, cells=BATCH_CELLS):
        best = RunningTopK(bc.value, k, tile, cells, _partial_sq_dist, MICRO, PICO)
        # articles per call so that (articles x query tokens) matrices stay bounded; of ids, (articles x queries)
        step = max(1, cells // max(1, len(best.payload["inv" if gather is None else "query_ids"])))
        step = step if gather is None else min(step, ID_ARTICLES)
        for big in batches:
            for s0 in range(0, big.num_rows, step):
                rb = big.slice(s0, step)
                _add_batch(best, rb.column(0).to_numpy(zero_copy_only=False), rb.column(1), gather)
        if counters is not None:
            for counter, n in zip(counters, (best.scored, best.seen)):
                counter.add(n)
        if best.real.any():
            yield best.rows()
    return kernel


def topk_closest(distances: DataFrame, k: int = 10, partition_col: str = "query_id",
                 order_id_col: str = "article_id") -> DataFrame:
    """k smallest distances per query; among equal distances the later article stays.

    ``rank`` follows the same order (distance ascending, later id first). Spark plans this
    as a partial ``WindowGroupLimit`` before the shuffle, so a single hot query moves at most
    ``k`` rows per input partition.
    """
    w = Window.partitionBy(partition_col).orderBy(F.col("distance").asc(), F.col(order_id_col).desc())
    return (distances.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def ranked_order(topk: DataFrame, places: int | None = 6) -> DataFrame:
    """Final shape: ``query_id, rank, article_id, distance`` (distance rounded for display)."""
    d = F.round("distance", places) if places is not None else F.col("distance")
    return topk.select("query_id", F.col("rank").cast("int").alias("rank"), "article_id", d.alias("distance"))


def nearest_articles(articles: DataFrame, queries: DataFrame, k: int = 10, **kw) -> DataFrame:
    """Top-k articles per query (``search``): distances, each task's best, window top-k."""
    return ranked_order(topk_closest(article_query_distances(articles, queries, k=k, **kw), k))


def min_distance_per_query_token(articles: DataFrame, queries: DataFrame, **kw) -> DataFrame:
    """``(query_id, tok_no, article_id, nearest_pos, min_distance)``: for each query token the
    nearest token of each article (the theta join of query and article tokens, evaluated
    inside the Arrow kernel so no pair table is ever materialised)."""
    return article_query_distances(articles, queries, mode="tokens", **kw)


def mean_best_distance(minima: DataFrame) -> DataFrame:
    """Average of the per-token minima over the query's tokens (partial + final aggregate)."""
    pico = round_half_away(F.col("min_distance") * PICO)  # exact integer sum, order-free
    return minima.groupBy("query_id", "article_id").agg(
        (F.sum(pico).cast("double") / F.count(F.lit(1)).cast("double") / PICO).alias("distance"))


def selected_articles(articles: DataFrame, topk: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Chosen ids back to their articles, by key (never by list position).

    The top-k side holds ``k`` rows per query; no broadcast is forced: AQE broadcasts it when
    its measured size is under the threshold and keeps a shuffle join otherwise.
    """
    top = topk.withColumnRenamed("article_id", "_chosen")
    return articles.join(top, articles[id_col] == top["_chosen"], "inner").drop("_chosen")


LONG_SCHEMA = "query_id long, tok_no long, article_id long, p long"


def _long_batch(art: np.ndarray, vec: pa.Array, qp: dict):
    """Per-batch minimum per (article, query token) over the article's rows in this batch."""
    if len(art) == 0:
        return None
    lengths = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
    if lengths.min() != qp["dim"] or lengths.max() != qp["dim"]:
        raise ValueError(f"token vectors must have {qp['dim']} components")
    return _long_minima(art, _to_micro(vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, qp["dim"])), qp)


def _long_minima(art: np.ndarray, X: np.ndarray, qp: dict) -> pa.RecordBatch:
    """Minimum per (article, query token) over token vectors in micro-units."""
    Q = qp["Qu"]
    order = np.argsort(art, kind="stable")
    art, X = art[order], X[order]
    starts = np.flatnonzero(np.r_[True, art[1:] != art[:-1]])
    G, rest = _partial_sq_dist(X, Q)
    m = np.minimum.reduceat(G, starts, axis=0) + rest[None, :]
    pico = np.floor(np.sqrt(np.maximum(m, 0.0)) * MICRO + 0.5)[:, qp["inv"]]
    na, nt = pico.shape
    rows, cols = np.repeat(np.arange(na), nt), np.tile(np.arange(nt), na)
    return pa.RecordBatch.from_arrays(
        [pa.array(qp["tok_query"][cols], pa.int64()), pa.array(qp["tok_no"][cols], pa.int64()),
         pa.array(art[starts][rows], pa.int64()), pa.array(pico[rows, cols].astype(np.int64), pa.int64())],
        names=["query_id", "tok_no", "article_id", "p"])


def _combined(out: DataFrame) -> DataFrame:
    """Partial minima, combined by a ``min`` aggregate (partial, then final)."""
    return (out.groupBy("query_id", "tok_no", "article_id")
            .agg((F.min("p").cast("double") / PICO).alias("min_distance")))


def _bit_hashes(V: np.ndarray) -> np.ndarray:
    """A hash of the bits of each row of a float32 matrix."""
    bits = np.ascontiguousarray(V).view(np.uint32)
    odd = np.random.default_rng(7).integers(0, 1 << 63, V.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.einsum("ij,j->i", bits, odd, dtype=np.uint64, casting="safe")


def _distinct_vectors(V: np.ndarray) -> tuple:
    """The distinct rows of a float32 matrix and each row's place among them. Rows meet by a hash of
    their bits; if two different rows share one, all rows are kept."""
    _, first, row_of = np.unique(_bit_hashes(V), return_index=True, return_inverse=True)
    row_of = row_of.reshape(-1)
    X = V[first]
    if (X.view(np.uint32)[row_of] != np.ascontiguousarray(V).view(np.uint32)).any():
        return V, np.arange(len(V))
    return X, row_of


def _run_minima(arts: np.ndarray, V: np.ndarray, Q: np.ndarray) -> tuple:
    """``(articles, minima)``: squared distances of each run of an article's vectors to the query tokens.
    Equal vectors are scored once."""
    X, row_of = _distinct_vectors(V)
    G, rest = _partial_sq_dist(_to_micro(X), Q)
    starts = np.flatnonzero(np.append(True, arts[1:] != arts[:-1]))
    row_of, counts = _distinct_tokens(row_of, np.diff(np.append(starts, len(arts))), len(X))
    stops = np.cumsum(counts)
    out = np.empty((len(starts), Q.shape[0]))
    step = max(1, TILE_ELEMENTS // max(1, Q.shape[0]))
    a = 0
    while a < len(starts):  # whole runs, about a tile's rows at a time
        before = int(stops[a] - counts[a])
        b = max(a + 1, int(np.searchsorted(stops, before + step, "right")))
        np.minimum.reduceat(G[row_of[before:stops[b - 1]]], stops[a:b] - counts[a:b] - before, axis=0, out=out[a:b])
        a = b
    out += rest
    return arts[starts], out


class _BestMinima:
    """A task's ``k`` closest articles per query, with their minima per distinct query token."""

    def __init__(self, payload: dict, k: int):
        self.payload, self.k = payload, k
        n = len(payload["query_ids"])
        self.limit = np.full(n, np.inf)  # the k-th distance of each query so far
        self.query, self.row = np.empty(0, np.int64), np.empty(0, np.int64)
        self.distance = np.empty(0)
        self.ids, self.pico = np.empty(0, np.int64), np.empty((0, payload["Qu"].shape[0]))
        self.open = None  # the last article, which may go on: its id and minima

    def add(self, arts: np.ndarray, minima: np.ndarray, last: bool = False) -> None:
        """Minima of articles in the order of the table; the last article stays open."""
        if self.open is not None:
            if len(arts) and arts[0] == self.open[0]:
                np.minimum(minima[0], self.open[1], out=minima[0])
            else:
                arts, minima = np.append(self.open[0], arts), np.vstack([self.open[1], minima])
        self.open = None
        if not last and len(arts):
            self.open = (arts[-1:], minima[-1].copy())
            arts, minima = arts[:-1], minima[:-1]
        if len(arts):
            self._keep(arts, np.floor(np.sqrt(np.maximum(minima, 0.0)) * MICRO + 0.5))

    def _keep(self, arts: np.ndarray, pico: np.ndarray) -> None:
        p = self.payload
        # the same operations on the same exact sums as ``mean_best_distance``: ties stay ties
        distance = np.add.reduceat(pico[:, p["inv"]], p["starts"], axis=1) / p["counts"] / PICO
        row, query = np.nonzero(distance <= self.limit)
        if not len(row):
            return
        new = np.unique(row)
        ids, held = np.append(self.ids, arts[new]), np.vstack([self.pico, pico[new]])
        queries = np.append(self.query, query)
        rows = np.append(self.row, len(self.ids) + np.searchsorted(new, row))
        distances = np.append(self.distance, distance[row, query])
        order = np.lexsort((-ids[rows], distances, queries))
        first = np.searchsorted(queries[order], np.arange(len(self.limit)))
        place = np.arange(len(order)) - first[queries[order]]
        full = order[place == self.k - 1]
        self.limit[queries[full]] = distances[full]
        order = order[place < self.k]
        self.query, self.distance = queries[order], distances[order]
        used, self.row = np.unique(rows[order], return_inverse=True)
        self.row = self.row.reshape(-1)
        self.ids, self.pico = ids[used], held[used]

    def minima(self):
        """``LONG_SCHEMA`` rows of the pairs held."""
        p = self.payload
        sizes = p["counts"][self.query]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(p["starts"][self.query] - (ends - sizes), sizes)
        rows = np.repeat(self.row, sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(p["tok_query"][at], pa.int64()), pa.array(p["tok_no"][at], pa.int64()), pa.array(self.ids[rows], pa.int64()),
             pa.array(self.pico[rows, p["inv"][at]].astype(np.int64), pa.int64())], names=["query_id", "tok_no", "article_id", "p"])


def _model_vectors(batches, fn, size: int, typed: bool):
    """``(articles, vectors)`` of the real positions of model input rows, by micro-batches."""
    for rb in batches:
        art = rb.column(0).to_numpy(zero_copy_only=False)
        for s in range(0, len(art), size):
            part = rb.slice(s, size)
            ids, mask, types = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(part.num_rows, -1) for c in (1, 2, 3))
            vecs = np.asarray(fn(ids, mask, types) if typed else fn(ids, mask), dtype=np.float32)
            real = mask.astype(bool)
            if real.any():
                yield np.repeat(art[s:s + size], real.sum(axis=1)), vecs[real]


def _vector_groups(pairs, most: int):
    """``(articles, vectors)`` of whole articles, about ``most`` vectors together (or one article's); what goes on of a
    longer article is held as its distinct vectors."""
    held, n = [], 0
    for arts, vecs in pairs:
        held.append((arts, vecs))
        n += len(arts)
        if n < most:
            continue
        arts, vecs = (np.concatenate(x) for x in zip(*held))
        cut = int(np.flatnonzero(np.append(True, arts[1:] != arts[:-1]))[-1])  # the last article may go on
        if cut:
            yield arts[:cut], vecs[:cut]
        rest = vecs[cut:] if cut else _distinct_vectors(vecs)[0]
        held, n = [(arts[cut:cut + len(rest)], rest)], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


class _MetVectors:
    """The different model vectors that a worker has met, as rows of a matrix in micro-units that is made
    where it is read, and their index. Vectors meet by a hash of their bits and are compared."""

    def __init__(self, payload: dict):
        self.index = NearRows(payload["Qu"])
        self.vectors, self.used = np.empty((0, payload["dim"]), np.float32), 0
        self.hashes, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)

    def __len__(self) -> int:
        return self.used

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return _to_micro(self.vectors[:self.used][rows])

    def _add(self, V: np.ndarray, tokens: float) -> np.ndarray:
        rows = np.arange(self.used, self.used + len(V))
        if len(rows) and rows[-1] >= len(self.vectors):
            self.vectors = np.concatenate([self.vectors[:self.used], V, np.empty((self.used + len(V), V.shape[1]), np.float32)])
        self.vectors[rows] = V
        self.used += len(V)
        for s in range(0, len(V), NEW_ROWS):
            self.index.grow(_to_micro(V[s:s + NEW_ROWS]), tokens)
        return rows

    def rows_of(self, V: np.ndarray, articles: int) -> np.ndarray:
        """Row of each of the vectors of so many articles."""
        X, place = _distinct_vectors(V)
        if V.shape[1] != self.vectors.shape[1]:
            raise ValueError(f"token vectors must have {self.vectors.shape[1]} components")
        codes = _bit_hashes(X)
        at = np.minimum(np.searchsorted(self.hashes, codes), max(0, len(self.hashes) - 1))
        rows = np.full(len(X), -1)
        if len(self.hashes):
            known = np.flatnonzero(self.hashes[at] == codes)
            same = (self.vectors[self.rows[at[known]]].view(np.uint32) == X[known].view(np.uint32)).all(axis=1)
            rows[known[same]] = self.rows[at[known[same]]]
        new = np.flatnonzero(rows < 0)
        rows[new] = self._add(X[new], len(V) / articles)
        self.hashes, self.rows = np.append(self.hashes, codes[new]), np.append(self.rows, rows[new])
        order = np.argsort(self.hashes, kind="stable")  # of equal hashes the first one meets
        self.hashes, self.rows = self.hashes[order], self.rows[order]
        return rows[place]


def min_distance_model(inputs: DataFrame, queries: DataFrame, encoder, id_col: str = "article_id",
                       max_block_bytes: int = DEFAULT_QUERY_BLOCK_BYTES, k: int | None = None) -> DataFrame:
    """Like ``min_distance_long`` for model input rows (``input_ids``, ``input_mask``,
    ``input_type_ids``; an article may have several): the encoder runs inside the scoring
    task on micro-batches, so its vectors never become JVM rows.

    With ``k``, the minima of pairs that cannot be among a query's ``k`` closest articles are left
    out: an article's input rows are brought next to each other in one task, which sends the minima
    of its own ``k`` best per query (by distance, later id first) once.
    """
    from .embed import gathered, worker_model
    src = inputs.select(F.col(id_col).cast("long").alias("article_id"), "input_ids", "input_mask", "input_type_ids")
    make, key, size, typed = encoder.make_predict_fn, encoder.key, encoder.batch_size, encoder.with_types

    def make_kernel(bc):
        def kernel(batches, bc=bc):
            payload, fn = bc.value, worker_model(key, make)
            for arts, vecs in _model_vectors(batches, fn, size, typed):
                yield _long_minima(arts, _to_micro(vecs), payload)

        def best_kernel(batches, bc=bc, cells=BATCH_CELLS, tile=TILE_ELEMENTS):
            payload, fn = bc.value, worker_model(key, make)
            groups = _vector_groups(_model_vectors(batches, fn, size, typed), MODEL_VECTORS)
            first = next(groups, None)
            if first is None:
                return
            groups = chain([first], groups)
            if 2 * len(_distinct_vectors(first[1])[0]) > len(first[1]):  # vectors that articles seldom share
                best, most = _BestMinima(payload, k), max(1, cells // max(1, payload["Qu"].shape[0]))
                for arts, vecs in groups:
                    for s in range(0, len(arts), most):  # vectors scored together
                        best.add(*_run_minima(arts[s:s + most], vecs[s:s + most], payload["Qu"]))
                if best.open is not None:
                    best.add(np.empty(0, best.open[0].dtype), np.empty((0, payload["Qu"].shape[0])), last=True)
                if len(best.query):
                    yield best.minima()
                return
            best = RunningTopK(payload, k, tile, cells, _partial_sq_dist, MICRO, PICO, minima=True)
            for arts, vecs in groups:
                met = _met(payload, _MetVectors)
                starts = np.flatnonzero(np.append(True, arts[1:] != arts[:-1]))
                rows, counts = _distinct_tokens(met.rows_of(vecs, len(starts)), np.diff(np.append(starts, len(arts))), len(met))
                best.add(arts[starts], met, rows, counts, met.index)
                if met.vectors[:met.used].nbytes > MET_BYTES:
                    _MET.clear()
            if best.real.any():
                yield best.minima()
        return kernel if k is None else best_kernel

    return _combined(_passes(src, queries, max_block_bytes, LONG_SCHEMA, make_kernel, "inputs",
                             None if k is None else lambda rows: gathered(rows, "article_id")))


def min_distance_long(tokens: DataFrame, queries: DataFrame, id_col: str = "article_id", vec_col: str = "vec",
                      max_block_bytes: int = DEFAULT_QUERY_BLOCK_BYTES) -> DataFrame:
    """``(query_id, tok_no, article_id, min_distance)`` from a long token table (one row per
    article token), without grouping the vectors by article first.

    Each Arrow batch takes its own minimum per (article, query token) - an article split over
    batches or partitions yields several partial minima - and a ``min`` aggregate (partial,
    then final) combines them, so a very large article costs one row per partition.
    """
    src = tokens.select(F.col(id_col).cast("long").alias("article_id"), F.col(vec_col).alias("vec"))

    def make_kernel(bc):
        def kernel(batches, bc=bc, cap=BATCH_CELLS):
            payload = bc.value
            step = max(1, cap // max(1, len(payload["inv"])))
            for big in batches:
                for s0 in range(0, big.num_rows, step):
                    rb = big.slice(s0, step)
                    out = _long_batch(rb.column(0).to_numpy(zero_copy_only=False), rb.column(1), payload)
                    if out is not None:
                        yield out
        return kernel

    return _combined(_passes(src, queries, max_block_bytes, LONG_SCHEMA, make_kernel, "tokens"))
