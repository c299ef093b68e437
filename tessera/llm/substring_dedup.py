"""Removal of repeated byte strings across a corpus by suffix arrays.

A byte goes if some ``length``-byte string that covers it also starts earlier (a smaller
document id, or the same document further up). The work is done in four steps:

1. documents are packed into shards and written to the shared folder; a document whose whole
   text came up under a smaller id goes entirely: found by digests, it is skipped from here on;
2. every window of ``length`` bytes picks the smallest hash of the ``GRAM``-byte strings in it.
   Equal windows pick equal hashes, so a window whose hash occurs nowhere else in the corpus
   is proven unique and never enters an array;
3. each shard builds the suffix array and common prefixes of its remaining windows, settles
   all repeats within the shard and keeps the earliest of each;
4. those meet by picked hash; equal windows of different shards are found by binary search
   in the merged order, and all but the earliest go.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, per_worker, utf8, written
from .suffix_arrays import window_classes

GRAM = 32
#: bytes of text in a shard (a longer document is a shard of its own) and in one suffix array
SHARD_BYTES = BLOCK_BYTES = 1 << 20
#: occurrences of one picked hash above which its windows are dealt out one by one
HOT_HASH = 4096
#: pieces of text merged at a time
MERGE_PIECES, MERGE_WINDOWS = 8192, 1 << 18
MAX_DOCS = 1 << 20
LAST = np.int64((1 << 63) - 1)
PLACE_MASK = np.uint64((1 << 21) - 1)


# -- 1. shards

def write_shards(docs: DataFrame, id_col: str, text_col: str, length: int, key_col: str | None = None) -> DataFrame:
    """``(shard, ids, sizes, flags, keys, digests, blob)``: some documents, their texts compressed one
    after another; ``flags`` has 1 for a null id, ``keys`` are the rows' ``key_col``, one a line,
    ``digests`` the SHA-256 of each text of at least ``length`` bytes that has an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pack = zstandard.ZstdCompressor(level=3)
        count, ids, flags, keys, digests, texts, size = TaskContext.get().partitionId() << 31, [], [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal count, ids, flags, keys, digests, texts, size
            order = np.array([LAST if i is None else i for i in ids], np.int64)
            parts = [order.tobytes(), np.array(list(map(len, texts)), np.int64).tobytes(), bytes(flags), "\n".join(keys).encode(),
                     b"".join(digests), pack.compress(b"".join(texts))]
            out = pa.record_batch([pa.array([count], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)],
                                  ["shard", "ids", "sizes", "flags", "keys", "digests", "blob"])
            count, ids, flags, keys, digests, texts, size = count + 1, [], [], [], [], [], 0
            return out

        for batch in batches:
            for i, text, key in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                if ids and (size + len(text) > SHARD_BYTES or len(ids) >= MAX_DOCS):
                    yield shard()
                ids.append(i)
                keys.append(key)
                flags.append(i is None)
                texts.append(text)
                if i is not None and len(text) >= length:
                    digests.append(hashlib.sha256(text).digest())
                size += len(text)
        if ids:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.col(key_col) if key_col else F.lit("")).alias("key"))
    return written(rows.mapInArrow(run, "shard long, ids binary, sizes binary, flags binary, keys binary, digests binary, blob binary"), "shards")


def whole_copies(shards: DataFrame, length: int) -> DataFrame:
    """``(shard, copies)``: the rows of each shard, of at least ``length`` bytes, whose text a smaller id
    has as well: all their windows start earlier there, and whatever repeats theirs repeats the
    other's. Other texts of the same id are not meant.

    Only digests and places are shuffled: the texts stay in their shards.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _unpacked(batch):
                at = np.flatnonzero((np.frombuffer(r["sizes"], np.int64) >= length) & (np.frombuffer(r["flags"], np.uint8) == 0))
                if len(at):
                    digests = [r["digests"][k:k + 32] for k in range(0, len(r["digests"]), 32)]
                    yield pa.record_batch([pa.array(np.full(len(at), r["shard"])), pa.array(at.astype(np.int32)),
                                           pa.array(np.frombuffer(r["ids"], np.int64)[at]), pa.array(digests, pa.binary())],
                                          ["shard", "row", "id", "digest"])

    rows = written(shards.select("shard", "ids", "sizes", "flags", "digests")
                   .mapInArrow(run, "shard long, row int, id long, digest binary"), "digests")
    # one row per repeated text, written: the join below can then split a text of very many copies
    first = written(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    # also written: a grouping in the join's stage would keep it from being split
    later = written(rows.join(first, "digest").where("id > first").select("shard", "row"), "later")
    return written(later.groupBy("shard").agg(F.collect_list("row").alias("copies")), "copies")


class Shard:
    """One unpacked shard: the bytes, document bounds and document ids. Of whole copies only
    the place is left, without bytes."""

    def __init__(self, shard: int, ids: bytes, sizes: bytes, blob: bytes, copies: list | None = None):
        self.shard = shard
        self.ids = np.frombuffer(ids, np.int64)
        self.sizes = np.frombuffer(sizes, np.int64)
        total = int(self.sizes.sum())
        raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, total))
        self.text = np.frombuffer(raw, np.uint8)
        if copies:
            stay = np.ones(len(self.sizes), bool)
            stay[copies] = False
            self.text = self.text[np.repeat(stay, self.sizes)]
            self.sizes = self.sizes * stay
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def blocks(self, length: int) -> Iterator[tuple]:
        """``(number, first byte, last byte)``: stretches whose windows start in them only;
        a stretch also has the ``length - 1`` bytes after it."""
        for number, lo in enumerate(range(0, max(1, len(self.text)), BLOCK_BYTES)):
            yield number, lo, min(lo + BLOCK_BYTES + length - 1, len(self.text))

    def document_of(self, at: np.ndarray) -> np.ndarray:
        return self.owner[at]


def _unpacked(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch one at a time (a shard's text is unpacked only when its turn comes)."""
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


# -- 2. picked hashes

class Roller:
    """Powers of an odd multiplier and of its inverse, for hashes of all GRAM-byte strings."""

    def __init__(self, n: int):
        base = 0x9E3779B97F4A7C15
        self.up, self.down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        self.up[0] = self.down[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)


def picked_hashes(text: np.ndarray, length: int) -> tuple:
    """``(hash, place)`` for each window of ``length`` bytes: the smallest hash of the
    GRAM-byte strings in it and where that string starts (the last of equal ones)."""
    n = len(text)
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    powers = per_worker(("roller", BLOCK_BYTES + length), lambda: Roller(BLOCK_BYTES + length))
    sums = np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers.up[:n], dtype=np.uint64)
    h = sums[GRAM - 1:].copy()
    h[1:] -= sums[:-GRAM]
    h *= powers.down[:len(h)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    # sliding minimum of (hash, place) from running minima of aligned stretches, both ways
    w = length - GRAM + 1
    rows = -(-len(h) // w)
    grid = np.full(rows * w, np.uint64(2**64 - 1))
    grid[:len(h)] = (h | PLACE_MASK) - np.arange(len(h), dtype=np.uint64)
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (PLACE_MASK - (np.minimum(behind[:len(h) - w + 1], ahead[w - 1:len(h)]) & PLACE_MASK)).astype(np.int64)
    return h[place], place


def block_windows(shard: Shard, lo: int, hi: int, length: int) -> tuple:
    """``(starts, picked hash, its place)`` of the block's windows that stay within one document."""
    picked, place = picked_hashes(shard.text[lo:hi], length)
    starts = np.arange(lo, lo + len(picked))
    inside = starts + length <= shard.ends[shard.document_of(starts)] if len(starts) else np.empty(0, bool)
    return starts[inside], picked[inside], place[inside]


def repeated_hashes(shards: DataFrame, copies: DataFrame, length: int) -> DataFrame:
    """``(shard, hashes, modes)``: the picked hashes of each shard that occur again.

    Mode 0: only within one block; 1: in other blocks too; 2: so often (``HOT_HASH``) that its
    windows are compared one by one. Each block sends a hash once, with its count, so a
    passage that a third of all documents share costs one row per block.
    """
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _unpacked(batch):
                shard = Shard(row["shard"], row["ids"], row["sizes"], row["blob"], row["copies"])
                for _, lo, hi in shard.blocks(length):
                    starts, picked, place = block_windows(shard, lo, hi, length)
                    if not len(starts):
                        continue
                    # places only move on, so each picked place is one run of windows
                    head = np.concatenate([[True], place[1:] != place[:-1]])
                    hashes, n = np.unique(picked[head], return_counts=True)
                    yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), shard.shard)),
                                           pa.array(np.minimum(n, 1 << 30).astype(np.int32))], ["h", "shard", "n"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def settle(h, shard, n) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            rows = np.diff(np.append(cuts, len(h)))
            total = np.add.reduceat(n.astype(np.int64), cuts)
            mode = np.where(rows > 1, np.where(total > HOT_HASH, 2, 1), 0)
            keep = np.repeat(total > 1, rows)
            return pa.record_batch([pa.array(shard[keep]), pa.array(h[keep]), pa.array(np.repeat(mode, rows)[keep].astype(np.int8))],
                                   ["shard", "h", "mode"])

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(3)])
            if sum(len(x[0]) for x in held) >= 1 << 16:
                cols = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
                if cut:
                    yield settle(*[c[:cut] for c in cols])
                held = [[c[cut:] for c in cols]]
        if held and sum(len(x[0]) for x in held):
            yield settle(*[np.concatenate(x) for x in zip(*held)])

    marked = shards.join(copies, "shard", "left").select("shard", "ids", "sizes", "blob", "copies")
    rows = marked.mapInArrow(pick, "h long, shard long, n int")
    found = rows.repartition("h").sortWithinPartitions("h").mapInArrow(again, "shard long, h long, mode tinyint")
    return written(found.groupBy("shard").agg(F.collect_list(F.struct("h", "mode")).alias("found"))
                   .select("shard", F.col("found.h").alias("hashes"), F.col("found.mode").alias("modes")), "hashes")


# -- 3. suffix arrays within shards

def settle_block(shard: Shard, lo: int, hi: int, hashes: np.ndarray, modes: np.ndarray, length: int) -> tuple:
    """Windows of one block that repeat within it, and the earliest of each kind.

    Returns ``(starts to remove, earliest starts, their hashes, their modes)``.
    """
    none = np.empty(0, np.int64)
    starts, picked, place = block_windows(shard, lo, hi, length)
    if not len(starts) or not len(hashes):
        return none, none, np.empty(0, np.uint64), none
    # one look-up per run of windows that picked the same place
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    runs = np.diff(np.append(head, len(place)))
    at = np.minimum(np.searchsorted(hashes, picked[head]), len(hashes) - 1)
    maybe = np.repeat(hashes[at] == picked[head], runs)
    starts, picked, mode = starts[maybe], picked[maybe], np.repeat(modes[at], runs)[maybe]
    if not len(starts):
        return none, none, np.empty(0, np.uint64), none
    # only stretches covered by these windows enter the suffix array, one after another
    cut = np.flatnonzero(np.concatenate([[True], np.diff(starts) > 1]))
    first, last = starts[cut], starts[np.append(cut[1:] - 1, len(starts) - 1)]
    spans = last - first + length
    offset = np.cumsum(spans) - spans
    source = np.repeat(first - offset, spans) + np.arange(int(spans.sum()))
    local = starts + np.repeat(offset - first, np.diff(np.append(cut, len(starts))))
    # stretches that overlap can be longer together than the block: then in several arrays
    cuts = np.searchsorted(local, np.arange(0, int(local[-1]) + 1, BLOCK_BYTES))
    parts = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(local)]) if a < b]
    gone, kept = [], []
    doc = shard.document_of(starts)
    order = np.lexsort((np.arange(len(shard.ids)), shard.ids))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    age = place[doc] << 40 | (starts - shard.begins[doc])
    for a, b in parts:
        text = shard.text[source[local[a]:local[b - 1] + length]]
        where, classes = window_classes(text, local[a:b] - local[a], length)
        number = np.empty(len(text), np.int64)
        number[local[a:b] - local[a]] = np.arange(a, b)
        index = number[where]
        heads = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
        oldest = np.minimum.reduceat(age[index], heads)
        is_first = age[index] == np.repeat(oldest, np.diff(np.append(heads, len(index))))
        gone.append(index[~is_first])
        kept.append(index[is_first])
    gone, kept = np.sort(np.concatenate(gone)), np.sort(np.concatenate(kept))
    return starts[gone], starts[kept], picked[kept], mode[kept] if len(parts) == 1 else np.maximum(mode[kept], 1)


def _runs(starts: np.ndarray, *same: np.ndarray) -> tuple:
    """``(index of first, length)`` of runs of consecutive starts with equal other values."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate([[True], np.diff(starts) != 1])
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(starts)))


PIECES = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("shard", pa.int64()),
                    ("row", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("text", pa.binary())])
PIECES_DDL = "kind tinyint, h long, h2 long, doc long, shard long, row int, start long, n int, text binary"


def settled_pieces(shards: DataFrame, copies: DataFrame, hashes: DataFrame, length: int) -> DataFrame:
    """Kind 0: windows ``start .. start + n - 1`` of a row that go. Kind 1: windows to compare
    with other blocks, with their bytes, by picked hash. Kind 2: the same for hot hashes, one
    window each, by 128-bit hash of the window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _unpacked(batch):
                found = np.array(row["hashes"] or [], np.int64).view(np.uint64)
                modes = np.array(row["modes"] or [], np.int64)
                order = np.argsort(found, kind="stable")
                found, modes = found[order], modes[order]
                # a hash can come from several blocks of one long document
                if len(found):
                    head = np.concatenate([[True], found[1:] != found[:-1]])
                    found, modes = found[head], np.maximum.reduceat(modes, np.flatnonzero(head))
                shard = Shard(row["shard"], row["ids"], row["sizes"], row["blob"], row["copies"])
                for _, lo, hi in shard.blocks(length):
                    yield from _block_rows(shard, lo, hi, found, modes, length)

    both = (shards.join(hashes, "shard").join(copies, "shard", "left")
            .select("shard", "ids", "sizes", "blob", "copies", "hashes", "modes"))
    return written(both.mapInArrow(run, PIECES_DDL), "pieces")


def _block_rows(shard: Shard, lo: int, hi: int, found, modes, length: int) -> Iterator[pa.RecordBatch]:
    gone, kept, picked, mode = settle_block(shard, lo, hi, found, modes, length)
    # windows of one run lie in one document: a run never reaches over a document's last window
    head, n = _runs(gone, shard.document_of(gone))
    if len(head):
        yield _rows(0, shard, gone[head], n, None, None, None)
    for kind, chosen in ((1, mode == 1), (2, mode == 2)):
        at, h = kept[chosen], picked[chosen]
        if not len(at):
            continue
        raw = shard.text.tobytes() if kind == 1 else shard.text[lo:hi].tobytes()
        if kind == 1:
            head, n = _runs(at, h, shard.document_of(at))
            for a in range(0, len(head), 8192):
                s, m = at[head[a:a + 8192]], n[a:a + 8192]
                yield _rows(1, shard, s, m, h[head[a:a + 8192]].view(np.int64), None,
                            [raw[x:x + k + length - 1] for x, k in zip(s.tolist(), m.tolist())])
        else:
            for a in range(0, len(at), 1 << 16):
                s = at[a:a + (1 << 16)]
                digests = b"".join([xxhash.xxh3_128_digest(raw[x - lo:x - lo + length]) for x in s.tolist()])
                pair = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
                yield _rows(2, shard, s, np.ones(len(s), np.int64), pair[:, 0].copy().view(np.int64), pair[:, 1].copy().view(np.int64), None)


def _rows(kind, shard: Shard, starts, n, h, h2, texts) -> pa.RecordBatch:
    size, doc = len(starts), shard.document_of(starts)
    nothing = pa.nulls(size, pa.int64())
    return pa.record_batch([
        pa.array(np.full(size, kind, np.int8)), nothing if h is None else pa.array(h), nothing if h2 is None else pa.array(h2),
        pa.array(shard.ids[doc]), pa.array(np.full(size, shard.shard, np.int64)), pa.array(doc.astype(np.int32)),
        pa.array((starts - shard.begins[doc]).astype(np.int64)), pa.array(n.astype(np.int32)),
        pa.nulls(size, pa.binary()) if texts is None else pa.array(texts, pa.binary())], schema=PIECES)


# -- 4. merging across shards

GONE_DDL = "shard long, row int, start long, n int"


def _gone(shard, row, start, n) -> pa.RecordBatch:
    return pa.record_batch([pa.array(shard, pa.int64()), pa.array(row, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int32())],
                           ["shard", "row", "start", "n"])


def merge_windows(texts: list, n: np.ndarray, length: int) -> np.ndarray:
    """Which windows of some pieces of text (in order of age) also start in an earlier one.

    The merged order holds each distinct window once; every window is looked up in it by
    binary search, and the first to claim a place is the earliest.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(n + length - 1) - (n + length - 1)
    at = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at]).view(f"S{length}").ravel()
    merged = np.unique(windows)
    slot = np.searchsorted(merged, windows)
    _, first = np.unique(slot, return_index=True)
    later = np.ones(len(windows), bool)
    later[first] = False
    return later


def _merge_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def settle(cols: list) -> Iterator[pa.RecordBatch]:
            h, shard, row, start, n, texts = cols
            seen: set = set()
            again = np.zeros(len(h), bool)
            for i, t in enumerate(texts):  # pieces come in order of age: the same piece goes as a whole
                if t in seen:
                    again[i] = True
                else:
                    seen.add(t)
            if again.any():
                yield _gone(shard[again], row[again], start[again], n[again])
            left = np.flatnonzero(~again)
            hl = h[left]
            alone = np.concatenate([[True], hl[1:] != hl[:-1]]) & np.concatenate([hl[1:] != hl[:-1], [True]])
            left = left[~alone]
            # whole hashes at a time, as many as a bounded number of windows allows
            totals = np.cumsum(n[left])
            edges = np.flatnonzero(np.concatenate([[True], h[left][1:] != h[left][:-1]])) if len(left) else []
            bounds = [*edges, len(left)]
            a = 0
            while a < len(bounds) - 1:
                b = a + 1
                base = totals[bounds[a] - 1] if bounds[a] else 0
                while b < len(bounds) - 1 and totals[bounds[b + 1] - 1] - base <= MERGE_WINDOWS:
                    b += 1
                part = left[bounds[a]:bounds[b]]
                later = merge_windows([texts[i] for i in part], n[part], length)
                piece = np.repeat(part, n[part])
                where = np.arange(len(piece)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                piece, where = piece[later], where[later]
                head, m = _runs(where, piece)
                if len(head):
                    p = piece[head]
                    yield _gone(shard[p], row[p], start[p] + where[head], m)
                a = b

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            texts = np.empty(batch.num_rows, object)
            texts[:] = batch.column(5).to_pylist()
            held.append([*cols, texts])
            size += batch.num_rows
            if size >= MERGE_PIECES:
                cols = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
                if cut:
                    yield from settle([c[:cut] for c in cols])
                held, size = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if size:
            yield from settle([np.concatenate(x) for x in zip(*held)])

    return run


def cross_shard_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """Windows of kept pieces that also start earlier in another shard."""
    age = ["doc", "shard", "row", "start"]
    close = (pieces.where("kind = 1").select("h", "doc", "shard", "row", "start", "n", "text")
             .repartition("h").sortWithinPartitions("h", *age).select("h", "shard", "row", "start", "n", "text")
             .mapInArrow(_merge_pieces(length), GONE_DDL))
    one = pieces.where("kind = 2").select("h", "h2", "doc", "shard", "row", "start")
    oldest = one.groupBy("h", "h2").agg(F.min(F.struct(*age)).alias("oldest"))
    single = (one.join(oldest, ["h", "h2"]).where(F.struct(*age) != F.col("oldest"))
              .select("shard", "row", "start", F.lit(1).alias("n")))
    return close.unionByName(single)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, key_col: str | None = None) -> tuple:
    """``(shards, copies, gone)``: the packed documents, the whole copies and the windows to remove per shard."""
    shards = write_shards(docs, id_col, text_col, length, key_col)
    _let_go(docs)
    copies = whole_copies(shards, length)
    _let_go(docs)
    hashes = repeated_hashes(shards, copies, length)
    _let_go(docs)
    pieces = settled_pieces(shards, copies, hashes, length)
    _let_go(docs)
    all_gone = pieces.where("kind = 0").select("shard", "row", "start", "n").unionByName(cross_shard_repeats(pieces, length))
    gone = written(all_gone.groupBy("shard").agg(F.collect_list(F.struct("row", "start", "n")).alias("g"))
                   .select("shard", F.col("g.row").alias("rows"), F.col("g.start").alias("starts"), F.col("g.n").alias("ns")), "gone")
    _let_go(docs)
    return shards, copies, gone


def _let_go(df: DataFrame) -> None:
    """Shuffle files of finished steps go once nothing refers to them; everything still needed
    has been written."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def remaining(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, texts: bool = False,
              key_col: str | None = None) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` per row, with ``texts`` also ``kept`` and
    ``key``, the row's ``key_col``.

    ``kept`` is the remaining bytes as a string; a character of which some bytes went is
    dropped from it (the digest is over the bytes). Null and empty texts have no bytes.
    Rows with equal ids count as separate documents, in the order in which they were packed;
    null ids come after all others. Empty tables give an empty result.
    """
    shards, copies, gone = repeats(docs, id_col, text_col, length, key_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _unpacked(batch):
                yield _finish(r, length, texts)

    joined = (shards.join(gone, "shard", "left").join(copies, "shard", "left")
              .select("shard", "ids", "sizes", "flags", "keys", "blob", "copies", "rows", "starts", "ns"))
    ddl = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string, key string" if texts else "")
    return joined.mapInArrow(run, ddl)


def _finish(r: dict, length: int, texts: bool) -> pa.RecordBatch:
    copies = r.get("copies") or []
    shard = Shard(r["shard"], r["ids"], r["sizes"], r["blob"], copies)
    raw = shard.text.tobytes()
    change = np.zeros(len(raw) + 1, np.int64)
    if r["rows"]:
        start = shard.begins[np.array(r["rows"], np.int64)] + np.array(r["starts"], np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + np.array(r["ns"], np.int64) + length - 1, -1)
    covered = np.cumsum(change)[:-1] > 0
    flags, full, copies = r["flags"], np.frombuffer(r["sizes"], np.int64).tolist(), set(copies)
    keys = r["keys"].decode().split("\n") if texts else [None] * len(full)
    out: list = [[], [], [], [], [], [], []]
    for i, (lo, hi) in enumerate(zip(shard.begins.tolist(), shard.ends.tolist())):
        hit = covered[lo:hi]
        if i in copies:  # a whole copy: one run of removed bytes
            n, spans, kept = full[i], 1, b""
        else:
            n = int(hit.sum())
            spans = 0 if n == 0 else int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
            kept = raw[lo:hi] if n == 0 else shard.text[lo:hi][~hit].tobytes()
        row = (None if flags[i] & 1 else int(shard.ids[i]), full[i], n, spans, hashlib.sha256(kept).hexdigest(),
               kept.decode("utf-8", "ignore") if texts else None, keys[i])
        for c, v in zip(out, row):
            c.append(v)
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "key"][:7 if texts else 5]
    kinds = [pa.int64()] * 4 + [pa.string()] * 3
    return pa.record_batch([pa.array(c, k) for c, k, _ in zip(out, kinds, names)], names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """``docs`` with ``text_col`` cut down to what remains; all rows and columns stay.

    Every row gets its own remainder, also where ids are null or shared.
    """
    rows, key = keyed_rows(docs)
    left = (remaining(rows, id_col, text_col, length, texts=True, key_col=key)
            .select(F.col("key").alias(key), F.col("kept").alias("_rest")))
    return rows.drop(text_col).join(left, key).select(*[F.col("_rest").alias(c) if c == text_col else F.col(c) for c in docs.columns])
