"""Exact dedup through an extendible-hash index on shared files and byte-comparing owners."""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8, written

#: distinct keys that a bucket holds before it is split
CAPACITY = 1024
#: keys of more than one row that may be broadcast (16 bytes each); more are joined by shuffle
MAX_BROADCAST_KEYS = 1 << 20
#: rows of a key above which copies are folded in salted parts before they meet at their owner
HOT_ROWS, SALTS = 4096, 64
#: bytes of distinct texts that one task folds at a time
FOLD_BYTES = 48 << 20


def normal(text: Column) -> Column:
    """A text with A-Z lower-cased, nothing else changed (null: empty)."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def hash_key(text: Column, bits: int = 64) -> Column:
    """64-bit key that equal normalised texts share (``bits`` < 64: fewer keys, for tests).

    Full lower-casing is a function of the normalised text, so texts that differ in other
    letters' case only collide: their owner tells them apart.
    """
    key = F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))
    return key if bits == 64 else key.bitwiseAND(F.lit(-1 << (64 - bits)).cast("long"))


def _bucket(depth: int) -> Column:
    """Number of the bucket at ``depth``: a one, then the key's first ``depth`` bits."""
    return F.lit(1).cast("long") if depth == 0 else F.expr(f"shiftleft(1L, {depth}) | shiftrightunsigned(key, {64 - depth})")


class ExtendibleIndex:
    """Index entries ``(key, n)`` in bucket files: buckets of up to ``capacity`` distinct keys.

    The directory names a bucket by the key bits that lead to it. It begins as deep as the
    number of keys asks for; then each round doubles it: buckets that are overfull are
    read, dealt by one more bit of the key and written anew, the others stay as
    they are. Files are never changed, and a round that lost an executor is just run
    again. ``buckets`` is ``(bucket, key, n)``, ``directory`` is ``(bucket, depth, keys)``;
    both are tables in the shared folder, neither comes to the driver.
    """

    def __init__(self, keys: DataFrame, capacity: int = CAPACITY):
        keys = written(keys.select("key", "n"), "index-keys")
        total = keys.count()
        depth = max(0, math.ceil(math.log2(total / capacity))) if total else 0
        level = keys.withColumn("bucket", _bucket(depth))
        settled, directory = [], []
        while True:
            # files of key ranges: a bucket's keys lie together
            level = written(level.select("bucket", "key", "n").repartitionByRange("bucket", "key").sortWithinPartitions("key"), "index")
            sizes = written(level.groupBy("bucket").agg(F.count(F.lit(1)).alias("keys")).withColumn("depth", F.lit(depth)), "directory")
            full = sizes.where(F.col("keys") > capacity)
            directory.append(sizes.where(F.col("keys") <= capacity))
            if depth >= 62 or full.isEmpty():
                settled.append(level)
                directory.append(full)
                break
            settled.append(level.join(full, "bucket", "left_anti"))
            depth += 1
            bit = F.expr(f"shiftrightunsigned(key, {64 - depth}) & 1")
            level = level.join(full, "bucket", "left_semi").withColumn("bucket", F.col("bucket") * 2 + bit)
        self.buckets, self.directory = settled[0], directory[0]
        for more in settled[1:]:
            self.buckets = self.buckets.unionByName(more)
        for more in directory[1:]:
            self.directory = self.directory.unionByName(more)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(bucket, key, hot, text, n, top)`` with equal bytes made one: ``n`` summed, largest ``top``."""
    names = ["bucket", "key", "hot", "text", "n", "top"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()]
    held: dict = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        out, batch_bytes = [], 0
        for (bucket, key, hot, text), (n, top) in held.items():
            out.append((bucket, key, hot, text, n, top))
            batch_bytes += len(text)
            if batch_bytes > 8 << 20:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out, batch_bytes = [], 0
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (0, 1, 2)]
        for bucket, key, hot, text, n, top in zip(*columns, batch.column(3).to_pylist(), *(batch.column(i).to_pylist() for i in (4, 5))):
            at = (bucket, key, hot, text)
            old = held.get(at)
            if old is None:
                held[at] = (n, top)
                size += len(text)
            else:
                held[at] = (old[0] + n, top if old[1] is None else old[1] if top is None else max(old[1], top))
        if size > FOLD_BYTES:
            yield from rows()
            held.clear()
            size = 0
    yield from rows()


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (column 3) as normalised UTF-8; equal ones of a task folded."""
    def lower() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([t.lower() for t in utf8(batch.column(3))], pa.binary())  # bytes: A-Z only
            yield pa.record_batch([batch.column(i) if i != 3 else text for i in range(6)], batch.schema.names)
    return _fold(lower())


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct text of each key: texts of a key are chained, bytes compared."""
    names, kinds = ["key", "sha", "group_size", "keep_id"], [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    key, links = None, []
    out: list = []

    def close() -> None:
        seen: set = set()
        for text, n, top in links:
            sha = hashlib.sha256(text).hexdigest()
            if sha in seen:
                raise ValueError("two texts with one SHA-256")
            seen.add(sha)
            out.append((key, sha, n, top))

    for batch in batches:
        for k, text, n, top in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5))):
            if k != key:
                close()
                key, links = k, []
            for link in links:
                if link[0] == text:
                    link[1] += n
                    link[2] = top if link[2] is None else link[2] if top is None else max(link[2], top)
                    break
            else:
                links.append([text, n, top])
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
            out = []
    close()
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 key_bits: int = 64) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` per row: texts equal but for the case of A-Z.

    Keys and digests of all rows are written once (narrow); keys with their number of rows
    go into an ``ExtendibleIndex``. Only texts of keys that more than one row has are read again
    and sent to the bucket's owner task, which chains the texts of a key and compares bytes.
    Equal texts of a task become one row before that; keys of very many rows are folded once more
    in salted parts, so an owner never gets more than ``SALTS`` rows per distinct text of theirs.

    The row with the largest id stays. Null texts count as empty. Null ids are smaller than
    all others: such a row stays only if no row of its group has an id (``keep_id`` is null). Of
    repeated rows with that id one stays. Empty tables give no rows; other columns are ignored.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = read.withColumn("key", hash_key(F.col("text"), key_bits))
    entries = written(keyed.select(F.monotonically_increasing_id().alias("row"), "id", "key",
                                   F.sha2(normal(F.col("text")).cast("binary"), 256).alias("sha")), "entries")
    index = ExtendibleIndex(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")), capacity)
    shared = written(index.buckets.where("n > 1").select("bucket", "key", (F.col("n") > HOT_ROWS).alias("hot")), "shared")
    few = shared.count() <= MAX_BROADCAST_KEYS
    texts = keyed.join(F.broadcast(shared) if few else shared, "key")
    schema = "bucket long, key long, hot boolean, text binary, n long, top long"
    local = (texts.select("bucket", "key", "hot", "text", F.lit(1).cast("long").alias("n"), F.col("id").alias("top"))
             .mapInArrow(_lowered, schema))
    if not shared.where("hot").isEmpty():
        local = written(local, "copies")
        hot = local.where("hot").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        local = local.where("not hot").unionByName(hot.repartition("key", "salt").drop("salt").mapInArrow(_fold, schema))
    owned = local.repartition("bucket").sortWithinPartitions("bucket", "key")
    groups = owned.mapInArrow(_owner, "key long, sha string, group_size long, keep_id long")
    # which of the rows with that id stays
    rows = entries.groupBy("key", "sha").agg(F.max(F.struct("id", (-F.col("row")).alias("row")))["row"].alias("stays"))
    groups = written(groups.join(rows, ["key", "sha"]).withColumn("stays", -F.col("stays")), "groups")
    found = entries.join(groups, ["key", "sha"], "left")
    alone = F.col("group_size").isNull()
    return found.select("id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                        (alone | (F.col("stays") == F.col("row"))).alias("kept"), F.col("sha").alias("text_sha256"))
