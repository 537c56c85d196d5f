"""Text expressions: keyword tests, Python-compatible stripping, formats."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecensus import rules


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# A regex character class equal to Python's str.isspace() set. The \x{...}
# form is understood by both Java regex and RE2.
WS = "[" + "".join(f"\\x{{{cp:X}}}" for cp in rules.PY_WHITESPACE_CODEPOINTS) + "]"


def contains_any(col, words: Iterable[str]) -> Column:
    """True when the column contains any of the literal words."""
    c = _c(col)
    out = None
    for w in words:
        t = c.contains(w)
        out = t if out is None else (out | t)
    return out if out is not None else F.lit(False)


def ends_with_any(col, endings: Iterable[str]) -> Column:
    c = _c(col)
    out = None
    for e in endings:
        t = c.endswith(e)
        out = t if out is None else (out | t)
    return out if out is not None else F.lit(False)


def lines_of(col) -> Column:
    """str.split('\\n'): a trailing newline yields a final empty line."""
    return F.split(_c(col), "\n", -1)


def is_blank(line) -> Column:
    return _c(line).rlike(f"^{WS}*$")


def strip_py(col) -> Column:
    """str.strip() with Python's white-space set."""
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+$", "")


def first_line(col) -> Column:
    return F.substring_index(_c(col), "\n", 1)


def cut_with_ellipsis(col, keep: int, limit: int | None = None) -> Column:
    """``s[:keep] + '...' if len(s) > limit else s`` (limit defaults to keep)."""
    c = _c(col)
    limit = keep if limit is None else limit
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def fmt1(x) -> Column:
    """One decimal, rounded half-to-even like Python's '{:.1f}'."""
    return F.format_string("%.1f", F.bround(_c(x).cast("double"), 1))


def format_size(col) -> Column:
    """'0 B', else one decimal in B/KB/MB/GB (1024 steps)."""
    b = _c(col).cast("double")
    k = 1024.0
    return (F.when(b == 0, F.lit("0 B"))
             .when(b < k, F.concat(fmt1(b), F.lit(" B")))
             .when(b < k * k, F.concat(fmt1(b / k), F.lit(" KB")))
             .when(b < k * k * k, F.concat(fmt1(b / (k * k)), F.lit(" MB")))
             .otherwise(F.concat(fmt1(b / (k * k * k)), F.lit(" GB"))))


def safe_percentage(part, total) -> Column:
    """part / total * 100, or 0 when total is 0."""
    p, t = _c(part), _c(total)
    return F.when(t > 0, p.cast("double") / t * 100).otherwise(F.lit(0.0))
