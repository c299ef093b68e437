"""String expressions with the reference's Python text semantics, as JVM-side Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters Python's str.strip()/str.split() treat as whitespace
# (str.isspace): \t \n \x0b \x0c \r \x1c \x1d \x1e \x1f space \x85 \xa0 \u1680
# \u2000-\u200a \u2028 \u2029 \u202f \u205f \u3000, as one Java regex character class.
_WS_NARROW = "\\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F \\x{85}\\x{A0}"
_WS_WIDE = "\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
# the narrow ones are one bit table in Java; the wide ones are only looked at inside their range,
# so that a letter costs two tests and not one per listed range
PY_WS_CLASS = f"[{_WS_NARROW}[\\x{{1680}}-\\x{{3000}}&&[{_WS_WIDE}]]]"

NOT_PY_WS_CLASS = f"[^{_WS_NARROW}{_WS_WIDE}]"  # any character Python's strip() keeps

# Line endings after which no period is added
# (".", "!", "?", "...", "'", "`", '"', "’", "’", ")"); only one-character
# entries can equal a last character, so "..." and the repeated "’" change nothing.
END_TOKENS = [".", "!", "?", "...", "'", "`", '"', "’", "’", ")"]
HIGHLIGHT = "@highlight"
PAIR_SEPARATOR_RE = "(?s)^(.*) \\|\\|\\| (.*)\\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: trims all 29 Unicode whitespace characters, not only space."""
    return F.regexp_replace(_c(c), f"^{PY_WS_CLASS}+|{PY_WS_CLASS}+\\z", "")


strip_text = py_strip


def has_text(c) -> Column:
    """``strip(s) != ''`` without rewriting the string: true at the first non-space character."""
    return _c(c).rlike(NOT_PY_WS_CLASS)


def normalize_whitespace(c) -> Column:
    """``" ".join(s.split())``: whitespace runs become one space, ends trimmed (one regex
    pass; after it the only whitespace left at the ends is a plain space)."""
    return F.trim(F.regexp_replace(_c(c), f"{PY_WS_CLASS}+", " "))


def lower_case(c) -> Column:
    return F.lower(_c(c))


def document_name(path) -> Column:
    """Last path segment, ``path.split('/')[-1]``."""
    return F.element_at(F.split(_c(path), "/", -1), -1)


def add_missing_period(x: Column) -> Column:
    singles = [t for t in dict.fromkeys(END_TOKENS) if len(t) == 1]
    last = F.substring(x, -1, 1)
    return F.when(x.startswith(HIGHLIGHT) | last.isin(singles), x).otherwise(F.concat(x, F.lit(".")))


def raw_lines(raw) -> Column:
    """Split on ``\\n`` only, keeping empty pieces (Python ``str.split('\\n')``)."""
    return F.split(_c(raw), "\n", -1)


def story_lines(raw) -> Column:
    """Lines split on ``\\n``, stripped, empty ones dropped, missing periods added."""
    stripped = F.transform(raw_lines(raw), py_strip)
    nonempty = F.filter(stripped, lambda x: x != "")
    return F.transform(nonempty, add_missing_period)


def _marker_pos(lines: Column) -> Column:
    return F.array_position(F.transform(lines, lambda x: x.startswith(HIGHLIGHT)), True)


def story_part(lines) -> Column:
    """Lines before the first line starting with ``@highlight`` (all lines if none)."""
    lines = _c(lines)
    pos = _marker_pos(lines)
    return F.when(pos == 0, lines).otherwise(F.slice(lines, F.lit(1), (pos - 1).cast("int")))


def summary_part(lines) -> Column:
    """Lines after the first marker that do not start with ``@highlight``; ``[]`` if no marker."""
    lines = _c(lines)
    pos = _marker_pos(lines)
    after = F.slice(lines, (pos + 1).cast("int"), (F.size(lines) - pos).cast("int"))
    return F.when(pos == 0, F.array().cast("array<string>")).otherwise(
        F.filter(after, lambda x: ~x.startswith(HIGHLIGHT)))


def join_summary(lines) -> Column:
    return F.array_join(_c(lines), " ")


def detokenize(tokens) -> Column:
    """Tokens joined by a space, every ``" ##"`` removed (a leading ``##x`` stays)."""
    return F.replace(F.array_join(_c(tokens), " "), F.lit(" ##"), F.lit(""))


def split_pair_a(line) -> Column:
    s = py_strip(line)
    return F.when(s.rlike(PAIR_SEPARATOR_RE), F.regexp_extract(s, PAIR_SEPARATOR_RE, 1)).otherwise(s)


def split_pair_b(line) -> Column:
    s = py_strip(line)
    return F.when(s.rlike(PAIR_SEPARATOR_RE), F.regexp_extract(s, PAIR_SEPARATOR_RE, 2))


def words(text) -> Column:
    """Words of lower-cased text: runs of anything but Python's whitespace (no empty words)."""
    return F.array_remove(F.split(F.lower(_c(text)), f"{PY_WS_CLASS}+", -1), "")
