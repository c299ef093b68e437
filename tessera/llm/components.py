"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; component = smallest node.

    Links may repeat, be self-links or run either way; links with a null end are ignored; an
    empty table gives an empty result. Each round joins the links to the smallest neighbour
    of their end (a partial + final ``min``, then an equi-join whose hot key adaptive
    execution can split), first towards larger nodes (large-star), then towards smaller ones
    (small-star). The number of rounds is logarithmic in the component sizes. Each round is
    written to the shared checkpoint folder; the driver sees only a count and a checksum.
    """
    state = written(_tidy(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))), "cc")
    seen = _mark(state)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        state = written(_small_star(_large_star(state)), "cc")
        now = _mark(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _tidy(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller end."""
    return (edges.where("u is not null and v is not null and u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _mark(state: DataFrame) -> tuple:
    row = state.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.countDistinct("v")).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, one row per node: the join below can then split the links of a node that very many
    # others hang on (in one stage with the aggregate it could not)
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc")
    # each larger neighbour of u is linked to the smallest node around u
    ends = edges.select(F.col("v").alias("u"), F.col("u").alias("big"))
    return _tidy(ends.join(least, "u").select(F.col("big").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _tidy(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under links ``a[i] - b[i]`` (numpy)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root
