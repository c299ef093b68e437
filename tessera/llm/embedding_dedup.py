"""Near copies among embeddings by sorted projection passes.

Every pass puts a label's vectors in the lexicographic order of their concatenated random hashes
(signs of random projections, taken about the label's mean) and compares each with a
bounded window of neighbours; pairs that are verified in any pass are united into components.
The window covers a label of up to two windows wholly, so its one pass is exact; larger labels
get more passes, by the root of the number of windows. Links are then counted exactly among
the members of a component, so the window bounds no vector's number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ids import sequence_ids
from .common import written
from .components import connected_components, local_roots

#: neighbours on either side that a vector is compared with at least (twice as many at most)
WINDOW = 2048
#: sign bits of a pass's sort key, and the seed of their projections
HASH_BITS, SEED = 32, 20_011
#: a component is counted in parts of at most so many vectors; blocks inside a cell have BLOCK_ROWS
PART_ROWS, BLOCK_ROWS = 8192, 256
#: components of up to SMALL vectors are counted many in one task
SMALL = 1024
#: bytes of label means that may be broadcast (measured); more are joined by shuffle
MAX_MEANS_BYTES = 32 << 20
THRESHOLD = 0.98


def passes_of(n: Column, window: int) -> Column:
    """Passes over a label of ``n`` distinct vectors.

    In a dense topic of mutual cosine 0.95 a pair at 0.98 shares a window in about
    1.5 / sqrt(n / window) of the passes (vectors in general position in far more), so the passes
    grow with that root.
    """
    return F.when(n <= 2 * window, 1).otherwise(F.ceil(1 + 1.7 * F.sqrt(n / window))).cast("int")


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(label, vec, rep, copies, width)``: each distinct vector of a label once, with its smallest
    id. Null labels and vectors that are null, all zero, or hold null or non-finite numbers
    are left out: they link with nothing."""
    v = F.col("vec")
    fine = (F.col("label").isNotNull() & F.col("id").isNotNull() & v.isNotNull()
            & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
            & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast(_kind(vectors, vector_col)).alias("vec"))
    return (rows.where(fine).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"))
            .withColumn("width", F.size("vec")))


def _kind(vectors: DataFrame, vector_col: str) -> str:
    """Single precision stays so on its way (cosines are taken in double precision all the same)."""
    kind = vectors.select(vector_col).schema[0].dataType
    return "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"


def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    lists = column.take(pa.array(rows))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _blocks(unit: np.ndarray) -> list:
    """Row numbers in blocks of at most ``BLOCK_ROWS``, halved along the principal direction."""
    todo, out = [np.arange(len(unit))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK_ROWS:
            out.append(rows)
            continue
        x = unit[rows] - unit[rows].mean(axis=0)
        way = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(3):
            way = x.T @ (x @ way)
            way = way / max(np.abs(way).max(), 1e-300)
        order = np.argsort(x @ way, kind="stable")
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return out


def _balls(unit: np.ndarray, blocks: list) -> tuple:
    """Centre and radius of each block."""
    centres = np.stack([unit[b].mean(axis=0) for b in blocks])
    return centres, np.array([np.sqrt(((unit[b] - c) ** 2).sum(axis=1).max()) for b, c in zip(blocks, centres)])


def cell_links(unit: np.ndarray, copies: np.ndarray, first: int, threshold: float) -> tuple:
    """``(links, root)``: for each of the rows of ``unit`` how many vectors it links with and its
    smallest row under these links. Rows from ``first`` on are the second part and are
    compared with the rows before only; without such rows the first part is compared with itself."""
    n, own = len(unit), first == len(unit)
    links = (copies - 1 if own else np.zeros(n)).astype(np.int64)
    left = _blocks(unit[:first])
    right = left if own else [b + first for b in _blocks(unit[first:])]
    (centre_a, radius_a), (centre_b, radius_b) = _balls(unit, left), _balls(unit, right)
    # unit vectors that link are at most so far apart; single precision may err by so much
    reach, margin = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6, 1e-7 * (unit.shape[1] + 10)
    short = unit.astype(np.float32)
    found, held = [], 0
    for i, a in enumerate(left):
        apart = np.sqrt(((centre_b - centre_a[i]) ** 2).sum(axis=1)) - radius_a[i] - radius_b
        for j in np.flatnonzero(apart <= reach):
            if own and j < i:
                continue
            b = right[j]
            maybe = short[a] @ short[b].T >= threshold - margin
            rows, cols = a[maybe.any(axis=1)], b[maybe.any(axis=0)]
            if not len(rows):
                continue
            near = unit[rows] @ unit[cols].T >= threshold
            if own and i == j:
                near &= rows[:, None] != cols
                links[rows] += near @ copies[cols]
            else:
                links[rows] += near @ copies[cols]
                links[cols] += near.T @ copies[rows]
            x, y = np.nonzero(near)
            if len(x):
                root = local_roots(len(rows) + len(cols), x, y + len(rows))
                both, moved = np.concatenate([rows, cols]), np.flatnonzero(root != np.arange(len(root)))
                found.append((both[moved], both[root[moved]]))
                held += len(moved)
                if held > 16 * n + (1 << 16):
                    found, held = [_forest(n, found)], 0
    root = np.arange(n)
    if found:
        moved, to = _forest(n, found)
        root[moved] = to
    return links, root


def _forest(n: int, found: list) -> tuple:
    root = local_roots(n, *(np.concatenate(x) for x in zip(*found)))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _answer(rep: np.ndarray, links: np.ndarray | None, root: np.ndarray) -> pa.Table:
    """``(u, v, links)``: a spanning forest of links, and each vector's number of links."""
    moved = np.flatnonzero(root != np.arange(len(root)))
    counted = rep if links is not None else rep[:0]
    none = pa.nulls
    return pa.table({"u": np.concatenate([counted, rep[moved]]),
                     "v": pa.chunked_array([none(len(counted), pa.int64()), pa.array(rep[root[moved]], pa.int64())]),
                     "links": pa.chunked_array([pa.array([] if links is None else links, pa.int64()), none(len(moved), pa.int64())])})


ANSWER = "u long, v long, links long"


def small_label_links(classes: DataFrame, threshold: float) -> DataFrame:
    """Links of labels whose rows all lie in one another's window: one group each."""
    def cell(table: pa.Table) -> pa.Table:
        batch = table.select(["rep", "copies", "vec"]).combine_chunks()
        rep, copies = (batch.column(k).to_numpy() for k in (0, 1))
        unit = _unit(_matrix(batch.column(2).combine_chunks(), np.arange(len(rep))))
        return _answer(rep, *cell_links(unit, copies, len(rep), threshold))

    return classes.groupBy("label", "width").applyInArrow(cell, ANSWER)


def label_means(classes: DataFrame) -> DataFrame:
    """``(label, width, mean)`` of the unit vectors, summed within tasks first."""
    kind = classes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                coded = batch.column(0).take(pa.array(rows)).dictionary_encode()
                sums = np.zeros((len(coded.dictionary), int(size)))
                np.add.at(sums, coded.indices.to_numpy(), _unit(_matrix(column, rows)))
                yield pa.record_batch([coded.dictionary, pa.array(np.full(len(sums), size, np.int32)),
                                       pa.array(np.bincount(coded.indices.to_numpy(), minlength=len(sums))), pa.array(list(sums))],
                                      ["label", "width", "n", "sums"])

    parts = classes.select("label", "vec").mapInArrow(run, f"label {kind}, width int, n long, sums array<double>")
    long = parts.select("label", "width", "n", F.posexplode("sums").alias("i", "x"))
    # rounded, so that the order of summation moves no hash
    sums = long.groupBy("label", "width", "i").agg(F.round(F.sum("x") / F.sum("n"), 6).alias("m"))
    return sums.groupBy("label", "width").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def _hashed(classes: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """``(label, width, pass, key, cls)``: the sort key of every vector in every pass (no vectors)."""
    means = written(label_means(classes).join(sizes, ["label", "width"]), "label-means")
    held = means.agg(F.sum(F.col("width") * 8)).first()[0] or 0
    rows = classes.join(F.broadcast(means) if held <= MAX_MEANS_BYTES else means, ["label", "width"])
    kind = classes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            passes = batch.column(3).to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = _unit(_matrix(batch.column(1), rows)) - _matrix(batch.column(2), rows)
                for p in range(int(passes[rows].max())):
                    mine = rows[passes[rows] > p]
                    planes = np.random.default_rng([seed, p, int(size)]).standard_normal((int(size), HASH_BITS))
                    bits = (x[passes[rows] > p] @ planes > 0).astype(np.int64)
                    key = (bits << np.arange(HASH_BITS - 1, -1, -1)).sum(axis=1)
                    part = batch.take(pa.array(mine))
                    yield pa.record_batch([part.column(0), pa.array(np.full(len(mine), size, np.int32)),
                                           pa.array(np.full(len(mine), p, np.int32)), pa.array(key), part.column(4)],
                                          ["label", "width", "pass", "key", "cls"])

    return rows.select("label", "vec", "mean", "passes", "cls").mapInArrow(
        run, f"label {kind}, width int, pass int, key long, cls long")


def window_links(classes: DataFrame, sizes: DataFrame, threshold: float, seed: int = SEED) -> DataFrame:
    """Links ``(u, v)`` that connect what the passes find in the labels of ``sizes``.

    The sort keys are numbered in order and cut into blocks of two windows; a block also gets the
    window before it, so no neighbours are lost at a cut, and returns a spanning forest of
    its links.
    """
    window, order = WINDOW, ["label", "width", "pass", "key", "cls"]
    placed = sequence_ids(_hashed(classes, sizes, seed), order, "seq")
    block = F.floor(F.col("seq") / (2 * window)).cast("long")
    placed = placed.select("cls", "pass", "seq", F.explode(F.when(
        F.col("seq") % (2 * window) >= window, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"))
    rows = placed.join(classes.select("cls", "label", "rep", "vec"), "cls")
    rows = rows.select("block", "seq", F.xxhash64("pass", "label", F.size("vec")).alias("group"), "rep", "vec")

    def links(table: pa.Table) -> pa.Table:
        batch = table.sort_by("seq").combine_chunks()
        group, rep = (batch.column(c).to_numpy() for c in ("group", "rep"))
        vecs = batch.column("vec").combine_chunks()
        a_found, b_found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for lo, hi in zip(cuts, cuts[1:]):
            unit = _unit(_matrix(vecs, np.arange(lo, hi)))
            short, margin = unit.astype(np.float32), 1e-7 * (unit.shape[1] + 10)
            for a in range(0, hi - lo, window):
                x, y = np.nonzero(short[a:a + window] @ short[a:a + 2 * window].T >= threshold - margin)
                x, y = x[x < y] + a, y[x < y] + a
                for at in range(0, len(x), 1 << 18):  # verified in double precision, so many at a time
                    u, v = x[at:at + (1 << 18)], y[at:at + (1 << 18)]
                    near = np.einsum("ij,ij->i", unit[u], unit[v]) >= threshold
                    a_found.append(u[near] + lo)
                    b_found.append(v[near] + lo)
        root = local_roots(len(rep), np.concatenate(a_found), np.concatenate(b_found))
        return _answer(rep, None, root).select(["u", "v"])

    return rows.groupBy("block").applyInArrow(links, "u long, v long")


def component_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``(u, links)``: for every vector of ``(component, rep, copies, vec)`` how many vectors of its
    component it links with, other copies of itself included; vectors of components that were
    cut into parts come once per pair of parts."""
    sizes = written(members.groupBy("component").agg(F.count(F.lit(1)).alias("m")), "component-sizes")
    few = sizes.where(F.col("m") <= SMALL).agg(F.sum("m")).first()[0] or 0
    rows = members.join(sizes, "component")
    buckets = max(1, math.ceil(few / SMALL))
    small = (rows.where(F.col("m") <= SMALL)
             .select(F.lit(None).cast("long").alias("whole"), F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("low"),
                     F.lit(0).cast("long").alias("high"), F.lit(False).alias("second"), "component", "rep", "copies", "vec"))
    parts = F.ceil(F.col("m") / PART_ROWS).cast("long")
    large = (rows.where(F.col("m") > SMALL).withColumn("part", F.pmod(F.xxhash64("rep"), parts))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
             .select(F.col("component").alias("whole"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
                     (F.col("part") > F.col("other")).alias("second"), "component", "rep", "copies", "vec"))

    def count(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks()
        second, component, rep, copies = (batch.column(c).to_numpy() for c in ("second", "component", "rep", "copies"))
        order = np.lexsort((second, component))
        second, component, rep, copies = (x[order] for x in (second, component, rep, copies))
        unit = _unit(_matrix(batch.column("vec").combine_chunks(), order))
        links = np.zeros(len(rep), np.int64)
        if batch.column("whole")[0].as_py() is None:  # many small components
            cuts = [0, *(np.flatnonzero(np.diff(component)) + 1).tolist(), len(rep)]
            for lo, hi in zip(cuts, cuts[1:]):
                near = unit[lo:hi] @ unit[lo:hi].T >= threshold
                np.fill_diagonal(near, False)
                links[lo:hi] = near @ copies[lo:hi] + copies[lo:hi] - 1
        else:
            first = int(len(rep) - second.sum())
            if batch.column("low")[0].as_py() == batch.column("high")[0].as_py() or 0 < first < len(rep):
                links, _ = cell_links(unit, copies, first, threshold)
        return pa.table({"u": rep, "links": links})

    return small.unionByName(large).groupBy("whole", "low", "high").applyInArrow(count, "u long, links long")


def near_links(classes: DataFrame, threshold: float) -> tuple:
    """``(found, counts)``: components ``(node, component)`` of ``classes`` (with a number ``cls`` of
    their own), and ``(u, links)``, parts of each vector's number of links."""
    n = written(classes.groupBy("label", "width").agg(F.count(F.lit(1)).alias("n")), "label-sizes")
    window = WINDOW
    large = n.where(F.col("n") > 2 * window).select("label", "width", passes_of(F.col("n"), window).alias("passes"))
    small = small_label_links(classes.join(n.where(F.col("n") <= 2 * window), ["label", "width"]), threshold)
    small = written(small, "vector-links")
    links, counts = small.where("v is not null").select("u", "v"), small.where("v is null").select("u", "links")
    if large.isEmpty():
        return written(connected_components(links), "vector-groups"), counts
    big = written(classes.join(large.drop("passes"), ["label", "width"], "left_semi"), "large-labels")
    links = links.unionByName(written(window_links(big, large, threshold), "vector-links"))
    found = written(connected_components(links), "vector-groups")
    members = big.join(found, big["rep"] == found["node"]).select("component", "rep", "copies", "vec")
    return found, counts.unionByName(component_counts(members, threshold))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``(id, n_links, component, kept)`` per row of ``vectors``.

    Only vectors with equal labels (and widths) are compared, by cosine in double precision: all
    pairs of a label of up to two windows, the neighbours of every pass in larger ones (see
    ``passes_of``), and all pairs of a component for the numbers of links.
    Null labels, null, zero or non-finite vectors have no links and are their own component.
    Repeated rows with one id count as one vector; a null id links with nothing and has a
    null component. Equal vectors are one member with a number of copies until the end. An
    empty table gives an empty result; other columns are ignored.
    """
    classes = written(usable_vectors(vectors, id_col, vector_col, label_col)
                      .withColumn("cls", F.monotonically_increasing_id()), "vectors")
    found, parts = near_links(classes, threshold)
    counts = parts.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    answers = (classes.join(found, classes["rep"] == found["node"], "left").drop("node").join(counts, "rep", "left")
               .select(F.col("label").alias("_label"), F.col("vec").alias("_vec"),
                       F.coalesce("component", "rep").alias("_component"),
                       F.coalesce("links", F.col("copies") - 1).alias("_links")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast(_kind(vectors, vector_col)).alias("vec"))
    linked = rows.where("id is not null").join(
        answers, (rows["label"] == answers["_label"]) & (rows["vec"] == answers["_vec"]), "left").unionByName(
        rows.where("id is null"), allowMissingColumns=True)
    return (linked.select("id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
                          F.coalesce("_component", "id").alias("component"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False))))
