"""Array/token expressions for model inputs, as JVM-side Columns (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# BERT special tokens
CLS, SEP, PAD, UNK, MASK = "[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]"
BOS, EOS = "[unused0]", "[unused1]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def truncate_tokens(tokens, seq_length: int = 128) -> Column:
    """Keep the first ``seq_length - 2`` tokens (room for [CLS] and [SEP])."""
    return F.slice(_c(tokens), 1, seq_length - 2)


def add_special_tokens(tokens) -> Column:
    return F.concat(F.array(F.lit(CLS)), _c(tokens), F.array(F.lit(SEP)))


def truncate_or_pad(seq, block_size: int, pad_id=0) -> Column:
    """Cut to ``block_size`` or right-pad with ``pad_id``."""
    seq = _c(seq)
    pad = F.array_repeat(_lit(pad_id), F.greatest(F.lit(0), F.lit(block_size) - F.size(seq)))
    return F.slice(F.concat(seq, pad), 1, block_size)


def build_mask(seq, pad_id=0) -> Column:
    """1 where the id is not the pad id, else 0."""
    p = _lit(pad_id)
    return F.transform(_c(seq), lambda x: F.when(x == p, F.lit(0)).otherwise(F.lit(1)))


def real_mask(seq, seq_length: int) -> Column:
    """1 for each real token, 0 for padding up to ``seq_length`` (mask by position)."""
    n = F.size(_c(seq))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(seq_length) - n)))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0), n)


def truncate_pair_lengths(la, lb, max_length: int):
    """Lengths kept by the pop-the-longer rule (ties pop from b), in closed form.

    If both fit they are kept; otherwise a keeps ``least(la, greatest(m - lb, ceil(m/2)))``
    and b the rest of ``m``.
    """
    la, lb = _c(la), _c(lb)
    m = F.lit(max_length)
    fits = (la + lb) <= m
    ka = F.least(la, F.greatest(m - lb, F.floor((m + 1) / 2).cast("int")))
    ka = F.when(fits, la).otherwise(ka)
    kb = F.when(fits, lb).otherwise(m - ka)
    return ka.cast("int"), kb.cast("int")


def truncate_pair(a, b, max_length: int):
    a, b = _c(a), _c(b)
    ka, kb = truncate_pair_lengths(F.size(a), F.size(b), max_length)
    return F.slice(a, 1, ka), F.slice(b, 1, kb)


def segment_ids(seq, separator) -> Column:
    """Running count of separators minus one, modulo 2 (Python ``%``: -1 -> 1).

    Linear time: one run of equal values per separator (``array_repeat`` of the run's
    length), then ``flatten``. Positions before the first separator get 1; padding continues
    the last segment. Lambdas touch only their own elements.
    """
    seq = _c(seq)
    sep = _lit(separator)
    n = F.size(seq)
    # 0-based positions of the separators
    pos = F.filter(F.transform(seq, lambda x, i: F.when(x == sep, i)), lambda p: p.isNotNull())
    starts = F.concat(F.array(F.lit(0)), pos)
    ends = F.concat(pos, F.array(n))
    lengths = F.zip_with(starts, ends, lambda s, e: e - s)
    values = F.transform(starts, lambda s, j: F.pmod(j - 1, F.lit(2)))
    runs = F.zip_with(values, lengths, lambda v, l: F.array_repeat(v, l))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.flatten(runs))


def word_trigrams(words) -> Column:
    """Every run of three words, in order, joined by a space; [] when fewer than three.

    Built from three shifted copies zipped together, so the lambda touches only its own
    element (a lambda that slices the outer array would re-evaluate it per position).
    """
    w = _c(words)
    z = F.arrays_zip(w.alias("a"), F.slice(w, 2, 1 << 30).alias("b"), F.slice(w, 3, 1 << 30).alias("c"))
    full = F.filter(z, lambda t: t["c"].isNotNull())
    return F.transform(full, lambda t: F.concat_ws(" ", t["a"], t["b"], t["c"]))


def source_excerpt(tokens, n: int = 500) -> Column:
    """First ``n`` tokens joined by a space (word pieces and padding kept)."""
    return F.array_join(F.slice(_c(tokens), 1, n), " ")


def split_flat_index(idx, vocab_size):
    """Flat candidate index -> (beam, token id); integer division, exact for any 64-bit index."""
    idx = _c(idx).cast("long")
    v = _lit(vocab_size).cast("long")
    return F.call_function("div", idx, v), F.pmod(idx, v)
