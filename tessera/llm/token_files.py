"""Token-id files: documents' ids in ascending id order, range-coded in checksummed blocks.

A file is a row of sections, each ended by a line feed: ``D`` (some documents: their ids and
token counts), ``B`` (a block of token ids, coded on its own) and ``E`` (totals). All numbers
are little-endian; every section states its length and carries a CRC-32.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import range_coder
from .common import ModelFile, TwoGenerationCache, per_worker, utf8, written

#: text taken at a time, in bytes (and on to the next white space)
CHUNK, WHITE = 4 << 20, re.compile(rb"[ \t-\r]")
#: the first 0 to 8 bytes of a number, and odd factors
EIGHTS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
HASH = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
HEAD = struct.Struct("<cIII")  # kind, number of items, CRC-32 of the body, its length
#: token ids of words remembered by one Python worker, and the longest of them in bytes
CACHE_ENTRIES, CACHE_BYTES = 300_000, 64
#: steps of a ``tokenizers`` file before its model for which :class:`WordEncoder` takes words apart itself
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                                                  {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: a word of Latin-1 letters and ASCII marks behind them: one piece (lower-cased) or two under the steps above
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[!-&(-/:-@\\[-`{-~]"
#: words between single spaces: letters and marks, or any other word
PARTS = re.compile(f"(?:({LETTERS}+)({MARKS}*)|([^ ]+))(?: |$)")


def cut_words(data: bytes) -> tuple:
    """The words of a text that ends with white space, each different word once.

    ``(starts, sizes, words, codes)``: where the words start, their sizes, the different words (in
    no order), and the number in ``words`` of each. Words of up to 24 bytes meet by a hash of
    three numbers; those whose numbers are not the ones of the word they met are taken singly, as longer ones are.
    """
    text = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((text == 32) | (text - np.uint8(9) < 5))
    starts = np.append(0, ends[:-1] + 1)
    some = starts < ends
    starts, ends = starts[some], ends[some]
    sizes = ends - starts
    eights = np.frombuffer(data + bytes(40 - len(data) % 8), "<u8")
    at, off = starts >> 3, (starts & 7).astype(np.uint64) << np.uint64(3)
    keys, hashes = [], sizes.astype(np.uint64)
    part = eights.take(at)
    for k, odd in enumerate(HASH):
        after = eights.take(np.minimum(at + k + 1, len(eights) - 1))
        # a shift by 64 gives 0
        key = (part >> off | after << np.uint64(64) - off) & EIGHTS.take(sizes - 8 * k, mode="clip")
        hashes = (hashes ^ hashes >> np.uint64(29)) * odd + key
        keys.append(key)
        part = after
    codes, different = pd.factorize(hashes * HASH[0])
    place = np.empty(len(different), np.int64)
    place[codes] = np.arange(len(codes))
    alone, met = sizes > 24, place.take(codes)
    for values in (*keys, sizes):
        alone |= values != values.take(met)
    words = [data[a:b] for a, b in zip(starts.take(place).tolist(), ends.take(place).tolist())]
    single = np.flatnonzero(alone)
    if len(single):
        number = {w: i for i, w in enumerate(words)}
        codes[single] = [number.setdefault(data[a:b], len(number)) for a, b in zip(starts[single].tolist(), ends[single].tolist())]
        words = list(number)
    return starts, sizes, words, codes


class IdMemo(TwoGenerationCache):
    """A bounded memo of words' ids that is asked for many words at once."""

    def all(self, words: list, make: Callable) -> list:
        """The ids of ``words`` (empty: none); ``make`` gives those of different words not known."""
        found = list(map(self.get, words))
        if None not in found:
            return found
        missed = [i for i, v in enumerate(found) if v is None]
        asked = list(dict.fromkeys([words[i] for i in missed]))
        known = dict(zip(asked, map(self.old.get, asked)))
        fresh = [w for w, v in known.items() if v is None and w]
        if fresh:
            known.update(zip(fresh, make(fresh)))
        for i in missed:
            found[i] = known[words[i]] or b""
        self.update((w, v) for w, v in known.items() if len(w) <= CACHE_BYTES and v is not None)
        self.rotate()
        return found


class WordEncoder:
    """Ids of whole texts under a ``tokenizers`` file that never merges over white space.

    Texts are cut at ASCII white space, which the file's pre-tokenizer drops; the different words
    of a stretch of text are found in numpy, encoded by the library once and remembered within a bound. Under the steps above, words that
    differ in case or in the marks behind them share their letters' ids: the letters of many
    words are given to the library's model at once, each word's last id being one that ends words.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(data.decode())
        if self.library.get_vocab_size(with_added_tokens=True) > range_coder.ID_LIMIT:
            raise ValueError("the file format holds ids below 65536")
        for probe in ("a b", "x's \t 1 <|", "é\n  ü"):  # the cut must not change anything
            whole = self.library.encode(probe, add_special_tokens=False).ids
            if whole != [i for w in probe.split() for i in self.library.encode(w, add_special_tokens=False).ids]:
                raise ValueError("this tokenizer's ids depend on white space")
        self.cache, self.letters, self.marks = (IdMemo(CACHE_ENTRIES) for _ in range(3))
        self.lowered = self._for_lowered(json.loads(data))

    def _for_lowered(self, file: dict):
        """The library with the same model, for lower-case letters between spaces only (or None)."""
        model, steps = file["model"], (file.get("normalizer"), file.get("pre_tokenizer"), file["model"].get("type"))
        end = model.get("end_of_word_suffix")
        # an added token of letters, marks behind them or both could be part of a word that is taken apart
        added = any(re.fullmatch(f"{LETTERS}*{MARKS}*", t["content"]) for t in file.get("added_tokens") or [])
        if steps != (NORMALIZER, PRE_TOKENIZER, "BPE") or not end or model.get("dropout") or added:
            return None
        from tokenizers import Tokenizer
        self.ends = np.zeros(range_coder.ID_LIMIT, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(end)]] = True
        split = {"type": "WhitespaceSplit"}
        return Tokenizer.from_str(json.dumps(file | {"normalizer": None, "added_tokens": [],
                                                     "pre_tokenizer": PRE_TOKENIZER | {"pretokenizers": [split, PRE_TOKENIZER["pretokenizers"][1]]}}))

    def _by_word(self, words: list) -> list:
        """Ids of some words (strings) as the library gives them, one by one."""
        return [np.array(e.ids, "<u2").tobytes() for lo in range(0, len(words), 4096)
                for e in self.library.encode_batch_fast(words[lo:lo + 4096], add_special_tokens=False)]

    def _by_letters(self, words: list) -> list:
        """Ids of some words of lower-case letters, many at a time."""
        out = []
        for lo in range(0, len(words), 4096):
            part = words[lo:lo + 4096]
            ids = np.array(self.lowered.encode(" ".join(part), add_special_tokens=False).ids, "<u2")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):  # letters that the model does not know
                out += self._by_word(part)
                continue
            raw, cuts = ids.tobytes(), [0, *(cuts * 2).tolist()]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _fresh(self, words: list) -> list:
        """Ids of some different words (UTF-8)."""
        text = b" ".join(words).decode()
        if self.lowered is None:
            return self._by_word(text.split(" "))
        letters, marks, whole = zip(*PARTS.findall(text))
        letters = list(map(str.lower, letters))
        heads = self.letters.all(letters, self._by_letters)
        tails = self.marks.all(marks, self._by_word)
        # other words are in the memo of words
        rest = [t for t in whole if t]
        of = dict(zip(rest, self._by_word(rest)))
        return [h + t if h or t else of.get(w, b"") for h, t, w in zip(heads, tails, whole)]

    def _ids(self, data: bytes) -> tuple:
        """Ids of a stretch of text that ends with white space: all ids, the words' starts, and their numbers of ids."""
        starts, sizes, words, codes = cut_words(data)
        found = self.cache.all(words, self._fresh)
        pool, n = np.frombuffer(b"".join(found), "<u2"), np.fromiter(map(len, found), np.int64, len(found)) // 2
        counts = n.take(codes)
        # places in the pool, word by word
        first = (np.cumsum(n) - n).take(codes) - (np.cumsum(counts) - counts)
        return pool.take(np.repeat(first, counts) + np.arange(int(counts.sum()))), starts, counts

    def encode(self, texts: list) -> list:
        """16-bit ids of some texts (UTF-8), as bytes."""
        data = b" ".join(texts) + b" "
        ids, starts, counts, at = [], [], [], 0
        while at < len(data):
            upto = at + CHUNK
            if upto < len(data):  # on to the next white space
                upto = WHITE.search(data, upto - 1).end()
            part = self._ids(data[at:upto])
            for column, values in zip((ids, starts, counts), (part[0], part[1] + at, part[2])):
                column.append(values)
            at = upto
        raw = np.concatenate(ids).tobytes()
        before = np.append(0, np.cumsum(np.concatenate(counts))) * 2
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        cuts = [0, *before.take(np.searchsorted(np.concatenate(starts), ends)).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _section(kind: bytes, items: int, body: bytes) -> bytes:
    return HEAD.pack(kind, items, zlib.crc32(body), len(body)) + body


def parse_sections(data: bytes) -> Iterator[tuple]:
    """``(kind, items, body)`` of a file's sections, checked; a cut or changed file raises."""
    at = 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError("token file is cut short")
        kind, items, crc, size = HEAD.unpack_from(data, at)
        body = data[at + HEAD.size:at + HEAD.size + size]
        if len(body) < size or data[at + HEAD.size + size:at + HEAD.size + size + 1] != b"\n":
            raise ValueError("token file is cut short")
        if zlib.crc32(body) != crc:
            raise ValueError("token file section does not match its checksum")
        at += HEAD.size + size + 1
        yield kind, items, body


class FileWriter:
    """Sections of one file from a stream of documents' ids."""

    def __init__(self, part: int):
        self.part, self.docs, self.ids, self.n_ids = part, [], [], 0
        self.total_docs = self.total_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 2))
        self.ids.append(ids)
        self.n_ids += len(ids) // 2
        self.total_docs += 1
        self.total_ids += len(ids) // 2

    def full(self) -> bool:
        return self.n_ids >= range_coder.LANES * range_coder.BLOCK_IDS

    def sections(self, last: bool) -> Iterator[bytes]:
        """What can be written now; whole groups of blocks only, until the last."""
        if self.docs:
            ids = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
            nulls = np.array([d is None for d, _ in self.docs], np.uint8).tobytes()
            sizes = np.array([n for _, n in self.docs], "<u8").tobytes()
            yield _section(b"D", len(self.docs), struct.pack("<I", self.part) + zlib.compress(ids + nulls + sizes, 1))
        stream = np.frombuffer(b"".join(self.ids), "<u2")
        step = range_coder.BLOCK_IDS
        group = range_coder.LANES * step
        upto = len(stream) if last else len(stream) // group * group
        blocks = [stream[i:i + step] for i in range(0, upto, step)]
        for ids_, coded in zip(blocks, range_coder.encode_blocks(blocks)):
            yield _section(b"B", len(ids_), struct.pack("<I", range_coder.checksum(ids_)) + coded)
        self.docs, self.ids, self.n_ids = [], [stream[upto:].tobytes()], len(stream) - upto
        if last:
            yield _section(b"E", 0, struct.pack("<QQ", self.total_docs, self.total_ids))


def read_file(data: bytes) -> Iterator[tuple]:
    """``(part, doc id, start in the file, ids)`` of the documents of one file, in order."""
    docs, blocks, part, totals = [], [], 0, None
    for kind, items, body in parse_sections(data):
        if kind == b"D":
            part = struct.unpack_from("<I", body)[0]
            raw = zlib.decompress(body[4:])
            ids = np.frombuffer(raw, "<i8", items).tolist()
            nulls = np.frombuffer(raw, np.uint8, items, 8 * items).tolist()
            sizes = np.frombuffer(raw, "<u8", items, 9 * items).tolist()
            docs += [(None if z else d, n) for d, z, n in zip(ids, nulls, sizes)]
        elif kind == b"B":
            blocks.append((items, struct.unpack_from("<I", body)[0], body[4:]))
        elif kind == b"E":
            totals = struct.unpack("<QQ", body)
    if totals != (len(docs), sum(n for _, n in docs)):
        raise ValueError("token file does not hold what its end states")
    held, have, at, start = [], 0, 0, 0
    docs_at = 0
    for lo in range(0, max(1, len(blocks)), range_coder.LANES):
        group = blocks[lo:lo + range_coder.LANES]
        for ids_, (n, crc, _) in zip(range_coder.decode_blocks([b[2] for b in group], [b[0] for b in group]), group):
            if range_coder.checksum(ids_) != crc:
                raise ValueError("token block does not match its checksum")
            held.append(ids_.astype("<u4"))
            have += n
        stream, at = (np.concatenate(held) if held else np.empty(0, "<u4")), 0
        while docs_at < len(docs) and at + docs[docs_at][1] <= have:
            doc_id, n = docs[docs_at]
            yield part, doc_id, start, stream[at:at + n]
            at, start, docs_at = at + n, start + n, docs_at + 1
        held, have = [stream[at:]], have - at
    if docs_at < len(docs):
        raise ValueError("token file lacks blocks")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Token files of all texts in the folder ``path``, documents in ascending id order.

    Documents are range-partitioned by id: file k holds smaller ids than file k + 1. Null
    ids come first; rows with equal ids stay together in one file.
    """
    model = docs.sparkSession.sparkContext.broadcast(ModelFile(tokenizer))
    end = b"" if end_id is None else np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        m = model.value
        encoder = per_worker(("words", m.key), lambda: WordEncoder(m.data))
        writer = FileWriter(TaskContext.get().partitionId())
        empty = True

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            out: list = []
            for s in writer.sections(last):
                out.append(s)
                if len(out) >= 512:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["section"])
                    out = []
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], ["section"])

        for batch in batches:
            rows = max(1, batch.num_rows * CHUNK // max(1, batch.column(1).nbytes))
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(utf8(part.column(1)))):
                    writer.add(doc_id, ids + end)
                    empty = False
                if writer.full():
                    yield from ready(False)
        if not empty:
            yield from ready(True)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    in_order = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    # the text writer puts a section's bytes as they are and a line feed after them
    (in_order.mapInArrow(run, "section binary").select(F.col("section").cast("string").alias("value"))
     .write.option("lineSep", "\n").text(path))


def read_token_files(spark, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document in the files of ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [(p, d, s, len(ids), zlib.crc32(ids.tobytes())) for p, d, s, ids in read_file(data.as_py() or b"")]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["part", "id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    read = written(files.mapInArrow(run, "part long, id long, at long, n_tokens long, ids_crc32 long"), "token-docs")
    # one row per file: where it starts among all ids
    parts = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return read.join(starts, "part").select("id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token files of all whole texts (null: empty), written to the shared checkpoint folder
    and read back: ``(id, start, n_tokens, ids_crc32)`` per row.

    ``start`` counts the ids of all documents before it in ascending id order (null ids
    first). Other columns are ignored; an empty table gives an empty result.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id, id_col, text_col)
    return read_token_files(docs.sparkSession, path)
