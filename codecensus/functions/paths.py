"""Path projections as Spark column expressions.

Paths are '/'-separated and relative to the repository root.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecensus.functions import sql as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def name_of(path="path") -> Column:
    """Last path component."""
    if isinstance(path, str):
        return S.expr(S.name(path))
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def lower_name_of(path="path") -> Column:
    if isinstance(path, str):
        return S.expr(f"lower({S.name(path)})")
    return F.lower(name_of(path))


def suffix_of(path="path") -> Column:
    """Lower-cased suffix of the name: '.gitignore', 'file.' and 'x' give ''."""
    if isinstance(path, str):
        return S.expr(S.suffix(path))
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1))


def directory_of(path="path") -> Column:
    """Parent directory, or 'root' for top-level files."""
    if isinstance(path, str):
        return S.expr(S.directory(path))
    p = _c(path)
    return F.when(p.contains("/"), F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("root"))


def parts_of(path="path") -> Column:
    return F.split(_c(path), "/")


def parent_name_of(path="path") -> Column:
    """Name of the immediate parent directory ('' at the root)."""
    if isinstance(path, str):
        return S.expr(S.parent(path))
    p = _c(path)
    return F.when(p.contains("/"), F.regexp_extract(p, r"([^/]*)/[^/]*$", 1)).otherwise(F.lit(""))
