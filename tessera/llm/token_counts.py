"""Token counts of byte-level BPE: whole-token pre-tokens are counted without merging."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ModelFile, TwoGenerationCache, per_worker

#: white space of Unicode's White_Space property, as a class body
WHITE = r"\t-\r \x85\xa0  -     　"
# The pre-token pattern of byte-level BPE with its white space written out
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+"
           r"|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+")
#: merged pre-tokens remembered by one Python worker
CACHE_ENTRIES = 300_000
#: pre-tokens of more bytes are not worth remembering
CACHE_BYTES = 64


def byte_alphabet() -> dict:
    """The printable stand-in character of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return table


class BytePairCounter:
    """Counts the tokens of texts under a byte-level BPE vocabulary file (``tokenizers``)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        back = {c: b for b, c in byte_alphabet().items()}
        raw = lambda s: bytes(back[c] for c in s)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks: dict = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault((raw(a), raw(b)), rank)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.whole = self._whole_tokens([raw(t) for t in spec["model"]["vocab"] if t not in special])
        self.pieces = regex.compile(PATTERN).findall
        self.cache = TwoGenerationCache(CACHE_ENTRIES)

    def merge(self, word: bytes) -> list:
        """The tokens of one pre-token: the pair of lowest rank, leftmost first, is merged."""
        parts = [word[i:i + 1] for i in range(len(word))]
        if len(parts) > 256:
            return self._merge_long(parts)
        rank = self.ranks.get
        while len(parts) > 1:
            ranks = [rank(p, 1 << 60) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _merge_long(self, parts: list) -> list:
        """The same result with a heap of pairs, for pre-tokens of any length."""
        import heapq

        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        rank = self.ranks.get
        heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, (parts[left], parts[right])))
        return [p for p in parts if p is not None]

    def _whole_tokens(self, vocabulary: list) -> frozenset:
        """Strings of the vocabulary that the merges, run on the string alone, make one token.

        Only these may be counted without merging; a vocabulary string that its own merges
        never reach is left to the general path.
        """
        out = []
        for token in vocabulary:
            try:
                text = token.decode()
            except UnicodeDecodeError:
                continue  # never a whole pre-token of a text
            if len(self.merge(token)) == 1:
                out.append(text)
        return frozenset(out)

    def count(self, text: str) -> int:
        """Tokens of one whole text; strings of special tokens in it count one each."""
        if self.special is None:
            return self._count_plain(text)
        at = total = 0
        for m in self.special.finditer(text):
            total += 1 + self._count_plain(text[at:m.start()])
            at = m.end()
        return total + self._count_plain(text[at:] if at else text)

    def _count_plain(self, text: str) -> int:
        found, whole, cache = self.pieces(text), self.whole, self.cache
        rest = [p for p in found if p not in whole]
        total = len(found) - len(rest)
        for p in rest:
            n = cache.lookup(p)
            if n is None:
                n = len(self.merge(p.encode()))
                if len(p) <= CACHE_BYTES:
                    cache[p] = n
            total += n
        cache.rotate()
        return total


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every whole text (null: empty, 0 tokens).

    Pre-tokens that are proven whole tokens count one; the others are merged, with a bounded
    memo of recent results. No truncation, no begin or end tokens. One row per input row:
    repeated rows and null ids are kept; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(ModelFile(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        counter = per_worker(("token_counts", m.key), lambda: BytePairCounter(m.data))
        for batch in batches:
            counts = [0 if t is None else counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return (read.mapInArrow(run, "id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
