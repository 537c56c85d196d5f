"""Spark SQL text for rule expressions.

Large rule predicates (dozens of keyword tests) are written as one SQL
expression string and turned into a Column with a single ``F.expr`` call:
the plan is identical to composing Column objects, but building it costs
one JVM round trip instead of hundreds. Results are cached per text.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(s: str) -> str:
    """A Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(expr: str, values) -> str:
    return f"({expr} IN (" + ", ".join(q(v) for v in values) + "))"


def contains_any(expr: str, words) -> str:
    words = list(words)
    if not words:
        return "false"
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def ends_with_any(expr: str, endings) -> str:
    return "(" + " OR ".join(f"endswith({expr}, {q(e)})" for e in endings) + ")"


def name(p: str = "path") -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def suffix(p: str = "path") -> str:
    return f"lower(regexp_extract({name(p)}, {q(r'^.+(\.[^.]+)$')}, 1))"


def raw_suffix(p: str = "path") -> str:
    return f"regexp_extract({name(p)}, {q(r'^.+(\.[^.]+)$')}, 1)"


def directory(p: str = "path") -> str:
    return f"(CASE WHEN contains({p}, '/') THEN regexp_extract({p}, '^(.*)/[^/]*$', 1) ELSE 'root' END)"


def parent(p: str = "path") -> str:
    return f"(CASE WHEN contains({p}, '/') THEN regexp_extract({p}, '([^/]*)/[^/]*$', 1) ELSE '' END)"


def map_lookup(d: dict, key: str) -> str:
    """try_element_at over a literal map: a dictionary lookup without a join."""
    pairs = ", ".join(f"{q(k)}, {q(v)}" for k, v in d.items())
    return f"try_element_at(map({pairs}), {key})"


def case_first(branches: list[tuple[str, str]], default: str = "NULL") -> str:
    """CASE WHEN c1 THEN v1 ... ELSE default END (values are SQL text)."""
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {default} END)"


def points(terms: list[tuple[str, int]]) -> str:
    """Sum of (condition ? points : 0)."""
    return "(" + " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0 END)" for c, p in terms) + ")"


@lru_cache(maxsize=None)
def expr(text: str) -> Column:
    return F.expr(text)
