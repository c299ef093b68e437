"""Cross-tokenizer alignment: groups and links of two tokenizations by diagonal run skipping."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ModelFile, per_worker, written
from .sentence_pieces import MARK
from .token_counts import WHITE, byte_alphabet

#: characters of text aligned together, as one block (a longer document is a block of its own)
BLOCK_CHARS = 2 << 20
#: blocks that a task holds at once when it writes or reads them
BLOCKS_AT_ONCE = 4
#: units that one Python worker remembers before it starts anew, and bytes of their groups and links
UNIT_ENTRIES, UNIT_BYTES = 400_000, 64 << 20
#: white space that no longer piece of B holds (spaces only at its start): all but U+000D
_GAP = WHITE.replace(r"\t-\r", r"\t-\x0c")
#: white space and what follows it up to the next white space (U+000D and white space after it
#: included): no token of either side reaches over the start of such a unit, so units can be
#: encoded, aligned and remembered alone
UNIT = re.compile(f"[{_GAP}]*(?:[^{_GAP}\\r]|\\r[{_GAP}]*)+|[{_GAP}]+")


def units_of(text: str) -> list:
    """Keys of the units of space + text: a word that a line break or one space comes before
    (the space is left out), or a tuple that holds the unit as it is."""
    if not text:
        return []
    if " ".join(text.split()) == text.replace("\n", " "):
        return text.replace("\n", " \n").split(" ")
    return [(u,) for u in UNIT.findall(" " + text)]


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class TokenizerPair:
    """Units of texts under a byte-level BPE (A) and a SentencePiece BPE model (B), aligned once
    and remembered: token counts, groups as text, linked id pairs."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        back = {c: b for b, c in byte_alphabet().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in back for c in token):
                self.bytes_a[i] = bytes(back[c] for c in token)
        model = pb.ModelProto.FromString(pieces)
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("a model without text normalisation but with the leading space is needed")
        normal, byte = model.SentencePiece.NORMAL, model.SentencePiece.BYTE
        gap = re.compile(f"[{_GAP}]|(?<!^){MARK}(?!{MARK}*$)")
        if any(p.type == normal and len(p.piece) > 1 and gap.search(p.piece) for p in model.pieces):
            raise ValueError("pieces that reach over white space are not supported")
        self.bytes_b = [bytes([int(p.piece[1:-1], 16)]) if p.type == byte else p.piece.replace(MARK, " ").encode()
                        for p in model.pieces]
        rules.add_dummy_prefix = False  # a unit brings its own space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b)]
        self.size_a, self.size_b = sizes
        # a token's decimal id with what follows it: an A token of its group, the bar, a B token, the next group
        self.names = [f"{i}{end}".encode() for size, ends in ((len(sizes[0]), ",|"), (len(sizes[1]), ",;"))
                      for end in ends for i in range(size)]
        self.forget()

    def forget(self) -> None:
        """Begins anew with no units remembered (costs time only)."""
        self.number, self.groups = _Numbers(), []
        # per unit: tokens of A and B, groups (0 if a side loses bytes), and where its links end
        self.n_a = self.n_b = self.n_groups = np.empty(0, np.int64)
        self.link_ends, self.links = np.zeros(1, np.int64), np.empty(0, np.int64)
        self.group_bytes = 0

    def full(self) -> bool:
        return len(self.number) > UNIT_ENTRIES or self.group_bytes + self.links.nbytes > UNIT_BYTES

    def _encode_a(self, units: list) -> list:
        """Ids of A, unit by unit; units that end in no white space are encoded in one text."""
        def run(text: str) -> list:
            return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else []

        alone = [u[-1].isspace() for u in units]
        ids = np.array(run("".join(u for u, x in zip(units, alone) if not x)), np.int64)
        lengths = np.array([0 if x else len(u.encode()) for u, x in zip(units, alone)], np.int64)
        ends = np.cumsum(self.size_a[ids])
        cuts = np.searchsorted(ends, np.cumsum(lengths), "right") if len(ids) else np.zeros(len(units), np.int64)
        flat, at, out = ids.tolist(), 0, []
        for u, x, cut in zip(units, alone, cuts.tolist()):
            out.append(run(u) if x else flat[at:cut])
            at = cut
        return out

    def learn(self) -> None:
        """Encodes and aligns the units that were numbered since the last call."""
        have = len(self.groups)
        if len(self.number) == have:
            return
        keys = list(islice(self.number, have, None))
        units = [k[0] if type(k) is tuple else k if k[:1] == "\n" else " " + k for k in keys]
        a, b = self._encode_a(units), self.b.encode(units, num_threads=1)
        raw = [u.encode() for u in units]
        for side, tokens in ((a, self.bytes_a), (b, self.bytes_b)):
            back = [tokens[t] for t in chain.from_iterable(side)]
            if b"".join(back) == b"".join(raw):
                continue
            for i, ids in enumerate(side):  # which units does this side not give back?
                if b"".join([tokens[t] for t in ids]) != raw[i]:
                    a[i] = b[i] = ()
                    raw[i] = b""
        found = Alignment(self, a, b)
        self.groups += found.groups()
        self.group_bytes += sum(len(g) for g in islice(self.groups, have, None) if g)
        ends, links = found.links()
        self.n_a, self.n_b = np.append(self.n_a, np.diff(found.cut_a)), np.append(self.n_b, np.diff(found.cut_b))
        self.n_groups = np.append(self.n_groups, np.diff(found.cut_groups))
        self.link_ends = np.append(self.link_ends, ends + len(self.links))
        self.links = np.append(self.links, links)


def diagonal_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple:
    """Which tokens of A, and which of B, end where a token of the other side ends.

    Both arrays rise strictly and have the same last value. From a common end on, the arrays
    are compared at the current index shift over 1, 2, 4, ... entries; on the first difference the
    stretch is halved again, so a one-to-one stretch of n tokens costs O(log n) comparisons.
    The group that breaks the diagonal is walked token by token to its end, after which
    the shift is another one.
    """
    alone_a, alone_b = np.ones(len(ends_a), bool), np.ones(len(ends_b), bool)
    raw_a, raw_b = ends_a.astype(np.int64).tobytes(), ends_b.astype(np.int64).tobytes()
    a, b = ends_a.tolist(), ends_b.tolist()
    n, i, shift, size_b = len(a), 0, 0, len(b)
    inner_a, inner_b = [], []  # tokens inside groups
    while i < n:
        step, grow = 1, True
        while step:
            j = i + shift
            k = min(step, n - i, size_b - j)
            if k and raw_a[8 * i:8 * (i + k)] == raw_b[8 * j:8 * (j + k)]:
                i += k
                if grow:
                    step *= 2
                    continue
            grow = False
            step //= 2
        if i >= n:
            break
        j = i + shift
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                inner_a.append(i)
                i += 1
                x = a[i]
            else:
                inner_b.append(j)
                j += 1
                y = b[j]
        i += 1
        shift = j + 1 - i
    alone_a[inner_a] = False
    alone_b[inner_b] = False
    return alone_a, alone_b


def _gather(offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the entries of lists ``which`` in an array of lists cut at ``offsets``."""
    sizes = (offsets[1:] - offsets[:-1])[which]
    stops = np.cumsum(sizes)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(offsets[which] - (stops - sizes), sizes)


def _flat(lists: list) -> tuple:
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=offsets[1:])
    return offsets, np.fromiter(chain.from_iterable(lists), np.int64, int(offsets[-1]))


class Alignment:
    """Units laid end to end (both sides end where a unit ends), aligned in one go."""

    def __init__(self, pair: TokenizerPair, a: list, b: list):
        self.pair = pair
        (self.cut_a, self.a), (self.cut_b, self.b) = _flat(a), _flat(b)
        self.ends_a, self.ends_b = np.cumsum(pair.size_a[self.a]), np.cumsum(pair.size_b[self.b])
        self.last_a, self.last_b = diagonal_groups(self.ends_a, self.ends_b)
        self.cut_groups = np.concatenate([[0], np.cumsum(self.last_a)])[self.cut_a]

    def links(self) -> tuple:
        """Where each unit's links end, and the links (overlapping A-B occurrence pairs) in text
        order as ``A id << 32 | B id``.

        Between two neighbouring token ends (of either side) lies exactly one of them, so a
        group of x and y tokens has x + y - 1.
        """
        ends = np.concatenate([self.ends_a, self.ends_b[~self.last_b]])
        ends.sort(kind="stable")
        a, b = np.searchsorted(self.ends_a, ends), np.searchsorted(self.ends_b, ends)
        return (self.cut_a + self.cut_b - self.cut_groups)[1:], self.a[a] << 32 | self.b[b]

    def groups(self) -> list:
        """Each unit's groups ``a1,a2|b1;a3|b2,b3`` (no tokens: None)."""
        before = lambda last: np.cumsum(last) - last  # the group that a token is in
        group_a, group_b = before(self.last_a), before(self.last_b)
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        # A tokens stand after the B tokens of all groups before, B tokens after the A tokens of their own too
        at_a = np.arange(len(group_a)) + (np.cumsum(many_b) - many_b)[group_a]
        at_b = np.arange(len(group_b)) + np.cumsum(many_a)[group_b]
        codes = np.empty(len(at_a) + len(at_b), np.int64)
        codes[at_a] = self.a + len(self.pair.size_a) * self.last_a
        codes[at_b] = self.b + len(self.pair.size_b) * self.last_b + 2 * len(self.pair.size_a)
        listed, name = codes.tolist(), self.pair.names.__getitem__
        cuts = (self.cut_a + self.cut_b).tolist()
        return [b"".join(map(name, listed[x:y]))[:-1] if x < y else None for x, y in zip(cuts, cuts[1:])]


class Block:
    """The alignment of some documents, put together from their units."""

    def __init__(self, pair: TokenizerPair, texts: list):
        if pair.full():
            pair.forget()
        number = pair.number.__getitem__
        docs = [list(map(number, units_of(t))) for t in texts]
        pair.learn()
        lost = pair.n_groups == 0
        if lost.any():
            docs = [[] if d and lost[d].any() else d for d in docs]
        self.pair, self.docs = pair, docs
        self.starts, self.units = _flat(docs)

    def sums(self, figure: np.ndarray) -> np.ndarray:
        """Sum of a figure of units over each document."""
        return np.diff(np.concatenate([[0], np.cumsum(figure[self.units])])[self.starts])

    def digests(self) -> list:
        """SHA-256 of each document's groups (no tokens: empty)."""
        text = self.pair.groups.__getitem__
        return [hashlib.sha256(b";".join(map(text, d))).hexdigest() if d else "" for d in self.docs]

    def local(self) -> tuple:
        """``(pairs, counts, unit_links, unit_ends, units)``: distinct id pairs, how many links of the
        block hold them, each used unit's links as places in ``pairs`` (cut at ``unit_ends``), and the
        documents' units, numbered within the block."""
        pair = self.pair
        times = np.bincount(self.units, minlength=len(pair.groups))
        used = np.flatnonzero(times)
        links = pair.links[_gather(pair.link_ends, used)]
        pairs, places = np.unique(links, return_inverse=True)
        sizes = np.diff(pair.link_ends)[used]
        counts = np.bincount(places, np.repeat(times[used], sizes), len(pairs)).astype(np.int64)
        mine = np.cumsum(times > 0) - 1
        return pairs, counts, places, np.cumsum(sizes), mine[self.units]


def _models(docs: DataFrame, path_a: str, path_b: str):
    return docs.sparkSession.sparkContext.broadcast((ModelFile(path_a), ModelFile(path_b)))


def _pair(models) -> TokenizerPair:
    a, b = models.value
    return per_worker(("pair", a.key, b.key), lambda: TokenizerPair(a.data, b.data))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Ids and texts (null: empty) of about ``BLOCK_CHARS`` at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if size and size + len(t or "") > BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t or "")
            size += len(t or "")
    if ids:
        yield ids, texts


def _blocks_written(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    models = _models(docs, path_a, path_b)
    schema = ("block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
              "digests array<string>, pairs array<long>, counts array<long>, starts binary, units binary, unit_links binary, "
              "unit_ends binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block = _pair(models), TaskContext.get().partitionId() << 40
        longs = lambda x: pa.array([x], pa.list_(pa.int64()))
        packed = lambda x, kind=np.int32: pa.array([x.astype(kind).tobytes()], pa.binary())
        for ids, texts in _blocks(batches):
            found = Block(pair, texts)
            pairs, counts, unit_links, unit_ends, units = found.local()
            figures = (pair.n_a, pair.n_b, pair.n_groups, np.diff(pair.link_ends))
            yield pa.record_batch([pa.array([block], pa.int64()), longs(ids), *[longs(found.sums(x)) for x in figures],
                                   pa.array([found.digests()], pa.list_(pa.string())), longs(pairs), longs(counts),
                                   packed(found.starts, np.int64), packed(units), packed(unit_links), packed(unit_ends, np.int64)],
                                  [c.split()[0] for c in schema.split(", ")])
            block += 1

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(read.mapInArrow(run, schema), "aligned", BLOCKS_AT_ONCE)


def link_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, count, best)``: how many links of all documents hold each id pair, and whether no
    other pair of its B id has more. Counts are summed within each block before the shuffle."""
    parts = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    totals = written(parts.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count")), "links")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    # one row per id of B's vocabulary file, whose size is bounded by MAX_MODEL_BYTES
    most = totals.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return (totals.withColumn("b", b).join(F.broadcast(most), "b")
            .select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every whole text.

    A (a byte-level BPE file of ``tokenizers``) encodes space + text, B (a SentencePiece BPE
    model) the text. Texts that are null, empty or not given back byte for byte by both (such
    as those with U+2581) have zeros and ''. One row per input row: null ids and repeated
    rows are kept, each with the figures of its own text and counted each time; other columns are ignored.

    Documents are aligned in blocks, which are written once. A block asks for the corpus-wide
    counts of its distinct id pairs only: that join, whose frequent pairs come once per
    block, is the only one, and adaptive execution can split it.
    """
    blocks = _blocks_written(docs, path_a, path_b, id_col, text_col)
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(link_counts(blocks), "pair").select(F.col("block").alias("of_block"), "place", "count", "best")
    figures = ["ids", "n_a", "n_b", "n_groups", "n_links", "digests"]
    packed = ["starts", "units", "unit_links", "unit_ends"]

    def fold(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in (*figures, *packed)}
        starts, unit_ends = (np.frombuffer(row[c], np.int64) for c in ("starts", "unit_ends"))
        units, unit_links = (np.frombuffer(row[c], np.int32) for c in ("units", "unit_links"))
        sums = []
        for c in ("best", "count"):
            of_pair = np.zeros(right.num_rows, np.int64)
            of_pair[right.column("place").to_numpy()] = right.column(c).to_numpy()
            of_unit = np.diff(np.concatenate([[0], np.cumsum(of_pair[unit_links])])[np.concatenate([[0], unit_ends])])
            sums.append(np.diff(np.concatenate([[0], np.cumsum(of_unit[units])])[starts]))
        return pa.table([pa.array(row["ids"], pa.int64()), *[pa.array(row[c], pa.int64()) for c in figures[1:5]],
                         *[pa.array(x, pa.int64()) for x in sums], pa.array(row["digests"], pa.string())],
                        names=["id", *figures[1:5], "n_best", "count_sum", "groups_sha256"])

    return (blocks.select("block", *figures, *packed).groupBy("block").cogroup(answers.groupBy("of_block"))
            .applyInArrow(fold, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                                "groups_sha256 string"))


def aligned_groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, groups)``: each text's groups as ``struct(start, stop, a, b)``, bytes of space + text
    and the ids of both sides. Texts without an alignment (see ``align``) have an empty list."""
    models = _models(docs, path_a, path_b)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(models)
        for ids, texts in _blocks(batches):
            block, rows = Block(pair, texts), []
            for units in block.docs:
                start, out = 0, []
                for group in b";".join(map(pair.groups.__getitem__, units)).split(b";") if units else []:
                    a, b = ([int(i) for i in side.split(b",")] for side in group.split(b"|"))
                    stop = start + int(pair.size_a[a].sum())
                    out.append({"start": start, "stop": stop, "a": a, "b": b})
                    start = stop
                rows.append(out)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, kind)], ["id", "groups"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "id long, groups array<struct<start:long, stop:long, a:array<int>, b:array<int>>>")
