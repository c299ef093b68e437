"""Vector and scoring expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000  # 6 decimal places kept per component


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_vector(v, places: int = 6) -> Column:
    """Each component rounded to ``places`` decimals as a double."""
    return F.transform(_c(v), lambda x: F.round(x.cast("double"), places))


def round_half_away(y) -> Column:
    """Nearest integer, halves away from zero, in plain double arithmetic (code-generated;
    ``round`` on doubles goes through BigDecimal and costs far more per value)."""
    y = _c(y)
    return (F.signum(y) * F.floor(F.abs(y) + F.lit(0.5))).cast("long")


def to_micro(x) -> Column:
    """One component as integer micro-units."""
    return round_half_away(_c(x).cast("double") * MICRO)


def micro_units(v) -> Column:
    """Components as integer micro-units: exact, order-free arithmetic downstream."""
    return F.transform(_c(v), to_micro)


def squared_l2(a, b) -> Column:
    """Sum of squared differences of two equally long numeric arrays."""
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def squared_l2_micro(a, b) -> Column:
    """Exact squared distance on micro-unit integer arrays (bigint sum)."""
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0).cast("long"), lambda acc, x: acc + x)


def l2_distance(a, b) -> Column:
    """Euclidean distance, ``np.linalg.norm(a - b)``."""
    return F.sqrt(squared_l2(a, b))


def l2_distance_exact(a, b) -> Column:
    """Euclidean distance on components rounded to 6 places, computed on integers."""
    return F.sqrt(squared_l2_micro(micro_units(a), micro_units(b)).cast("double")) / MICRO


def length_penalty(kind: str, length, alpha: float = 0.95) -> Column:
    """Length penalty divisor: ``wu`` = ((5+n)^alpha)/(6^alpha), ``avg`` = n, else 1."""
    n = _c(length).cast("double")
    if kind == "wu":
        return F.pow(F.lit(5.0) + n, F.lit(alpha)) / F.pow(F.lit(6.0), F.lit(alpha))
    if kind == "avg":
        return n
    return F.lit(1.0)


def apply_length_penalty(kind: str, logprob, length, alpha: float = 0.95) -> Column:
    return _c(logprob) / length_penalty(kind, length, alpha)
