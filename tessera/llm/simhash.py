"""SimHash fingerprints of word shingles and their near-copy groups by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, utf8, written
from .components import connected_components, local_roots

BITS = 64
#: rows that one walk through the trie holds (groups of equal first block are kept whole)
CHUNK_ROWS = 1 << 16
#: members of a block group above which it is dealt out by the next trie levels
HOT_GROUP = 1 << 14
#: node pairs whose member pairs are compared directly instead of going further down
LEAF_PAIRS = 64
#: candidate pairs compared at a time
PAIRS_AT_ONCE = 1 << 20


def text_fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text: a bit is 1 if set in over half the shingle hashes."""
    tokens = text.lower().split()  # bytes: A-Z only, and splits at space and \t-\r only
    n = len(tokens) - shingle + 1
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at:at + 8192], ends[at:at + 8192])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                 key_col: str | None = None) -> DataFrame:
    """``(id, fp)``, with a ``key_col`` also ``key``: the signed 64-bit SimHash of every whole text.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles count with repeats; a
    text with fewer words is one shingle; null, empty and blank texts get fingerprint 0.
    Null ids and repeated rows are kept as they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((text_fingerprint(t, shingle) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["id", "fp", "key"][:batch.num_columns])

    key = [F.col(key_col).alias("key")] if key_col else []
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *key)
            .mapInArrow(run, "id long, fp long" + (", key string" if key else "")))


def _blocks(max_bits: int) -> list:
    """(first bit, width) of ``max_bits + 1`` blocks: links agree wholly on at least one."""
    cuts = [round(i * BITS / (max_bits + 1)) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def trie_links(fps: np.ndarray, group: np.ndarray, max_bits: int) -> tuple:
    """Index pairs of equal ``group`` whose fingerprints differ in at most ``max_bits`` bits.

    ``(group, fingerprint)`` must be sorted. Pairs of trie nodes are walked together level
    by level; a pair carries the bits in which its two prefixes differ and is dropped once
    they exceed ``max_bits``; pairs of small nodes are compared member by member.
    """
    edge = np.flatnonzero(np.diff(group)) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(fps)]])
    a_lo, a_hi, b_lo, b_hi, diff = lo, hi, lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
    found: list = []
    for bit in range(BITS):
        small = (a_hi - a_lo) * (b_hi - b_lo) <= LEAF_PAIRS
        found += _compare(fps, a_lo[small], a_hi[small], b_lo[small], b_hi[small], max_bits)
        a_lo, a_hi, b_lo, b_hi, diff = (x[~small] for x in (a_lo, a_hi, b_lo, b_hi, diff))
        if not len(a_lo):
            break
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(BITS - 1 - bit)) & np.uint64(1)).astype(np.int64)])
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = (a_lo == b_lo) & (a_hi == b_hi)
        parts = [(a_lo, a_mid, b_lo, b_mid, diff, None), (a_mid, a_hi, b_mid, b_hi, diff, None),
                 (a_lo, a_mid, b_mid, b_hi, diff + 1, None), (a_mid, a_hi, b_lo, b_mid, diff + 1, ~same)]
        out = []
        for al, ah, bl, bh, d, only in parts:
            keep = (al < ah) & (bl < bh) & (d <= max_bits)
            if only is not None:
                keep &= only
            out.append([x[keep] for x in (al, ah, bl, bh, d)])
        a_lo, a_hi, b_lo, b_hi, diff = (np.concatenate(x) for x in zip(*out))
    else:  # below the last bit: equal prefixes but for diff bits
        found += _compare(fps, a_lo, a_hi, b_lo, b_hi, max_bits)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _compare(fps, a_lo, a_hi, b_lo, b_hi, max_bits) -> list:
    """Member pairs of node pairs within ``max_bits``, compared a bounded number at a time."""
    out, width = [], (a_hi - a_lo) * (b_hi - b_lo)
    total = np.cumsum(width)
    at = 0
    while at < len(width):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + PAIRS_AT_ONCE, "right")))
        w = width[at:to]
        which = np.repeat(np.arange(at, to), w)
        k = np.arange(len(which)) - np.repeat(np.cumsum(w) - w, w)
        across = (b_hi - b_lo)[which]
        a, b = a_lo[which] + k // across, b_lo[which] + k % across
        ok = (a < b) | (a_lo[which] != b_lo[which])
        a, b = a[ok], b[ok]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        out.append((a[near], b[near]))
        at = to
    return out


def near_links(reps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links ``(u, v)`` that connect ``reps(fp, rep)`` (distinct fingerprints) within ``max_bits``.

    Fingerprints are rotated so that each of ``max_bits + 1`` blocks comes first once: a
    linked pair agrees on at least one whole block, so tries with the same first block meet in one task
    and the walk starts below it. A group larger than ``HOT_GROUP`` is dealt out by pairs of
    its next trie nodes. A task returns a spanning forest of the links that it finds (at most
    one per member), not all pairs.
    """
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), F.lit(first).alias("first"), F.lit(width).alias("width"))
                       for i, (first, width) in enumerate(_blocks(max_bits))])
    rows = (reps.where("rep is not null").select("fp", "rep", F.explode(blocks).alias("b"))
            .select("rep", F.col("b.block").alias("block"), F.col("b.width").alias("width"),
                    F.when(F.col("b.first") == 0, F.col("fp"))
                    .otherwise(F.expr("shiftleft(fp, b.first) | shiftrightunsigned(fp, 64 - b.first)")).alias("rot")))
    rows = rows.withColumn("value", F.expr("shiftrightunsigned(rot, 64 - width)"))
    # one row for each block and value: at most (max_bits + 1) * 2^width rows, whatever the input
    sizes = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_GROUP)
    depth = F.least(F.lit(12), F.ceil(F.log2(F.col("n") / HOT_GROUP))).cast("int")
    rows = rows.join(F.broadcast(sizes.select("block", "value", depth.alias("depth"))), ["block", "value"], "left")
    node = F.expr("shiftrightunsigned(shiftleft(rot, width), 64 - depth)")
    other = F.expr("filter(sequence(0L, shiftleft(1L, depth) - 1), x -> bit_count(x ^ node) <= %d)" % max_bits)
    cool = rows.where("depth is null").withColumn("cell", F.lit("-"))
    hot = (rows.where("depth is not null").withColumn("node", node).withColumn("o", F.explode(other))
           .withColumn("cell", F.concat_ws(":", F.least("node", "o"), F.greatest("node", "o"))).drop("node", "o"))
    cells = cool.unionByName(hot).select(F.xxhash64("block", "value", "cell").alias("g"), F.col("rot"), "rep")
    # unsigned order of the rotated fingerprint
    dealt = cells.repartition("g").sortWithinPartitions("g", F.expr("rot ^ (-9223372036854775807L - 1)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def links(cols) -> pa.RecordBatch:
            g, fps, rep = cols
            if len(g) == 0:
                a = b = np.empty(0, np.int64)
            else:
                a, b = trie_links(fps.view(np.uint64), g, max_bits)
            root = local_roots(len(rep), np.minimum(a, b), np.maximum(a, b)) if len(a) else np.arange(len(rep))
            moved = np.flatnonzero(root != np.arange(len(rep)))
            return pa.record_batch([pa.array(rep[moved]), pa.array(rep[root[moved]])], ["u", "v"])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held.append(cols)
            if sum(len(c[0]) for c in held) >= CHUNK_ROWS:
                cols = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last group may go on
                if cut:
                    yield links([c[:cut] for c in cols])
                held = [[c[cut:] for c in cols]]
        if held:
            yield links([np.concatenate(x) for x in zip(*held)])

    return dealt.mapInArrow(run, "u long, v long")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                     max_bits: int = 4) -> DataFrame:
    """``(id, fp, component)`` per row: texts whose fingerprints link (at most ``max_bits``
    differing bits, directly or through others) share the smallest id among them.

    Exact copies meet by fingerprint before the trie, so thousands of copies cost one trie
    member. A row with a null id takes the component of its fingerprint (null if no row of
    that component has an id). Empty tables give an empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    reps = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    found = connected_components(near_links(reps, max_bits))
    classes = (reps.join(found, reps["rep"] == found["node"], "left")
               .select("fp", F.coalesce("component", "rep").alias("component")))
    return fps.join(classes, "fp").select("id", "fp", "component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                     max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each near-copy group: the one with the smallest id (a null id is
    larger than all others; of repeated rows with that id the first). All columns stay.

    Groups are made of fingerprints, whatever the ids: rows with null ids link like any others, and
    a row that is like nothing else stays.
    """
    rows, key = keyed_rows(docs)
    fps = written(fingerprints(rows, id_col, text_col, shingle, key), "simhash")
    # a fingerprint stands for its rows, by its own number
    reps = fps.select("fp").distinct().withColumn("rep", F.col("fp"))
    found = connected_components(near_links(reps, max_bits))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    firsts = fps.groupBy("fp").agg(first.alias("first"))
    keep = (firsts.join(found, firsts["fp"] == found["node"], "left").groupBy(F.coalesce("component", "fp"))
            .agg(F.min("first")["key"].alias(key)).select(key))
    return rows.join(keep, key, "left_semi").drop(key)
