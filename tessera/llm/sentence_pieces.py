"""SentencePiece (BPE) encoding through a table of each prefix's last token, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ModelFile, TwoGenerationCache, per_worker

#: the mark that stands for a space inside pieces
MARK = "▁"
#: encoded words remembered by one Python worker, and the longest of them in characters
CACHE_ENTRIES, CACHE_CHARS = 250_000, 64
#: remembered pair tests
PAIR_ENTRIES = 1_000_000
# Piece types of the model file
UNKNOWN, CONTROL, BYTE = 2, 3, 6


class PieceModel:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback.

    A text's pieces are the unique sequence in which each neighbouring pair is stable: the
    merges, run on the pair's text alone, give back the pair. So one pass over a word can
    store for every prefix its last piece (found among the automaton's matches that end
    there, by testing the pair with the last piece of the prefix before it), and the pieces
    are recovered backwards.
    """

    def __init__(self, data: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        del sentencepiece
        spec = pb.ModelProto.FromString(data)
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a model without text normalisation is needed")
        if not spec.normalizer_spec.add_dummy_prefix:
            raise ValueError("a model with the leading space is needed")
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.id_of, self.score, self.gap_id, self.gap_score = {}, {}, {}, {}
        for i, p in enumerate(spec.pieces):
            if p.type not in (1, 4):
                continue
            if p.type == 4 or (MARK in p.piece[1:] and p.piece.strip(MARK)):
                raise ValueError("pieces that reach over a space are not supported")
            if len(p.piece) > 1 and not p.piece.strip(MARK):
                self.gap_id[len(p.piece)], self.gap_score[len(p.piece)] = i, p.score
            else:
                self.id_of[p.piece], self.score[p.piece] = i, p.score
        if self.gap_score and max(self.gap_score.values()) >= min(s for p, s in self.score.items() if len(p) > 1):
            raise ValueError("pieces of spaces must merge after all others")
        self.gap_id[1] = self.id_of[MARK]
        single = "".join(re.escape(p) for p in self.id_of if len(p) == 1)
        self.strange = re.compile(f"[^{single}]").search
        self.joined = [b"%d," % i for i in range(len(self.pieces))]
        self.plain = [None if k in (BYTE, UNKNOWN, CONTROL) else p.replace(MARK, " ").encode()
                      for p, k in zip(self.pieces, self.kinds)]
        self.matches = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.matches.add_word(piece, (len(piece), i))
        self.matches.make_automaton()
        self.stable: dict = {}
        self.gaps: dict = {}
        self.cache = TwoGenerationCache(CACHE_ENTRIES)

    # -- encoding

    def _merge(self, text: str) -> list:
        """The merges run step by step on a short text: best score first, leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stable(self, a: int, b: int) -> bool:
        """Whether the merges keep two neighbouring pieces as they are (remembered)."""
        if len(self.stable) >= PAIR_ENTRIES:
            self.stable.clear()
        pair = [self.pieces[a], self.pieces[b]]
        known = self.stable[a << 32 | b] = self._merge("".join(pair)) == pair
        return known

    def _known(self, word: str) -> list:
        """Ids of a word, all of whose characters are pieces, by the prefix table."""
        n = len(word)
        last, width = [-1] * (n + 1), [0] * (n + 1)
        memo, done = self.stable.get, -1
        for end, (size, token) in self.matches.iter(word):
            if end == done:
                continue  # this prefix's last piece is found: it is unique
            start = end + 1 - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                good = memo(before << 32 | token)
                if good is None:
                    good = self._stable(before, token)
                if not good:
                    continue
            last[end + 1], width[end + 1], done = token, size, end
        ids = []
        while n:
            ids.append(last[n])
            n -= width[n]
        ids.reverse()
        return ids

    def _gap(self, n: int) -> list:
        """Ids of ``n`` spaces in a row that no word takes: merged by score, leftmost first."""
        if n in self.gaps:
            return self.gaps[n]
        size, after, before = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)]
        score = self.gap_score.get
        heap = [(-score(2), i, 1, 1) for i in range(n - 1)] if 2 in self.gap_score else []
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if size[i] != a or j < 0 or size[j] != b:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (s := score(size[left] + size[right])) is not None:
                    heapq.heappush(heap, (-s, left, size[left], size[right]))
        out = [self.gap_id[s] for s in size if s]
        if len(self.gaps) < 1000:
            self.gaps[n] = out
        return out

    def _word(self, word: str) -> list:
        """Ids of a space mark and a word after it; characters that are no piece become bytes."""
        word = MARK + word
        if self.strange(word) is None:
            return self._known(word)
        ids, at, known = [], 0, self.id_of
        for i, c in enumerate(word):
            if c not in known:
                if at < i:
                    ids += self._known(word[at:i])
                ids += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
                at = i + 1
        return ids + self._known(word[at:]) if at < len(word) else ids

    def _units(self, text: str) -> Iterator[list]:
        """Ids of a text, word by word (no piece reaches from a word over the next space)."""
        if not text:
            return
        mark, gap = self.id_of[MARK], 0
        for word in text.replace(MARK, " ").split(" "):
            if not word:
                gap += 1
                continue
            ids = self._word(word)
            if gap:
                alone = ids[0] == mark
                yield self._gap(gap + alone)
                ids = ids[1:] if alone else ids
                gap = 0
            yield ids
        if gap:
            yield self._gap(gap)

    def encode(self, text: str) -> list:
        """Ids of a text, as the library gives them (no begin or end ids, no sampling)."""
        return [i for ids in self._units(text) for i in ids]

    # -- decoding

    def _bytes(self, ids: list) -> bytes:
        """UTF-8 of a run of ids, spaces for marks; the text's first space is still there."""
        out, pieces, kinds = [], self.pieces, self.kinds
        at = 0
        while at < len(ids):
            kind = kinds[ids[at]]
            if kind == BYTE:
                run = at
                while run < len(ids) and kinds[ids[run]] == BYTE:
                    run += 1
                out.append(_checked(bytes(int(pieces[i][1:-1], 16) for i in ids[at:run])))
                at = run
                continue
            if kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            elif kind != CONTROL:
                out.append(pieces[ids[at]].replace(MARK, " ").encode())
            at += 1
        return b"".join(out)

    def decode(self, ids: list) -> str:
        """Text of any ids: marks become spaces, the leading one goes, bytes that are no UTF-8
        become U+FFFD, control ids nothing."""
        rest = list(ids)
        while rest and self.kinds[rest[0]] == CONTROL:
            rest.pop(0)
        text = self._bytes(rest).decode()
        return text[1:] if rest and self.pieces[rest[0]].startswith(MARK) else text

    def digests(self, text: str) -> tuple:
        """``(n_tokens, sha256 of the ids joined by commas, sha256 of the decoded text)``."""
        ids, decoded, cache = [], [], self.cache
        words = text.replace(MARK, " ").split(" ") if text else []
        plain, listed = self.plain, self.joined
        gap, mark = 0, listed[self.id_of[MARK]]
        for word in words:
            if not word:
                gap += 1
                continue
            hit = cache.lookup(word)
            if hit is None:
                found = self._word(word)
                back = [plain[i] for i in found]
                hit = (b"".join([listed[i] for i in found]), self._bytes(found) if None in back else b"".join(back))
                if len(word) <= CACHE_CHARS:
                    cache[word] = hit
            joined, back = hit
            if gap:
                alone = joined.startswith(mark)
                spaces = self._gap(gap + alone)
                ids.append(b"".join([listed[i] for i in spaces]))
                decoded.append(self._bytes(spaces))
                if alone:
                    joined, back = joined[len(mark):], back[1:]
                gap = 0
            ids.append(joined)
            decoded.append(back)
        if gap:
            spaces = self._gap(gap)
            ids.append(b"".join([listed[i] for i in spaces]))
            decoded.append(self._bytes(spaces))
        cache.rotate()
        joined = b"".join(ids)
        return (joined.count(b","), hashlib.sha256(joined[:-1]).hexdigest(),
                hashlib.sha256(b"".join(decoded)[1:]).hexdigest())


def _checked(data: bytes) -> bytes:
    """Bytes as UTF-8, each byte that belongs to no character replaced by U+FFFD."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    data[at:at + size].decode()
                except UnicodeDecodeError:
                    continue
                out.append(data[at:at + size])
                break
            else:
                size = 1
                out.append("�".encode())
            at += size
        return b"".join(out)


def _model(m: ModelFile) -> PieceModel:
    return per_worker(("pieces", m.key), lambda: PieceModel(m.data))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text (null: empty).

    Words are encoded and decoded once per worker and remembered within a bound; the digests
    are those of the whole id list and the whole decoded text. One row per input row, null
    ids and repeated rows kept; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(ModelFile(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _model(model.value).digests
        for batch in batches:
            n, ids, decoded = zip(*[digests(t or "") for t in batch.column(1).to_pylist()]) if batch.num_rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                   pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with ``ids_col``, the ids of every whole text (null: no ids).

    A column of that name is replaced; all other columns, null ids and repeated rows stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(ModelFile(path))

    @F.pandas_udf("array<int>")
    def ids(texts):
        code = _model(model.value).encode
        return texts.map(lambda t: code(t or ""))

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(df: DataFrame, path: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``, the text of every id list (null or empty: empty text)."""
    model = df.sparkSession.sparkContext.broadcast(ModelFile(path))

    @F.pandas_udf("string")
    def texts(lists):
        back = _model(model.value).decode
        return lists.map(lambda x: back([] if x is None else list(x)))

    return df.withColumn(text_col, texts(F.col(ids_col)))
