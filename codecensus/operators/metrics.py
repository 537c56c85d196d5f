"""§2.5 Line and complexity metrics.

Per-file metrics are map-only: each file's text is split into lines inside
its own row and classified with higher-order functions, so no line row is
ever materialised or shuffled. Only the per-repo and per-language sums
shuffle, and they aggregate partially first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions import sql as S
from codecensus.functions.text import WS, is_blank, lines_of, safe_percentage
from codecensus.operators.classify import lookup


def comment_regex(prefixes: list[str]) -> str:
    """'^\\s*(p1|p2|...)' with Python's white-space set."""
    return f"^{WS}*(?:" + "|".join(re.escape(p) for p in prefixes) + ")"


def comment_test(language: Column, line: Column) -> Column:
    """One literal regex per distinct rule set, chosen by language."""
    groups: dict[tuple, list[str]] = {}
    for lang, prefixes in rules.COMMENT_PREFIXES.items():
        groups.setdefault(tuple(prefixes), []).append(lang)
    expr = None
    for prefixes, langs in groups.items():
        cond = language.isin(langs)
        test = line.rlike(comment_regex(list(prefixes)))
        expr = F.when(cond, test) if expr is None else expr.when(cond, test)
    return expr.otherwise(line.rlike(comment_regex(rules.DEFAULT_COMMENT_PREFIXES)))


def metric_columns(lines: Column, language: Column) -> list[Column]:
    """Per-file line classes and indentation from an array of lines (in-row)."""
    nonblank = F.filter(lines, lambda l: ~is_blank(l))
    comments = F.filter(nonblank, lambda l: comment_test(language, l))
    indent = F.array_max(F.transform(nonblank, lambda l: F.length(F.regexp_extract(l, f"^{WS}*", 0))))
    step = F.when(language == "Python", F.lit(4)).otherwise(F.lit(2))
    return [F.size(lines).cast("bigint").alias("lines"),
            (F.size(lines) - F.size(nonblank)).cast("bigint").alias("blank_lines"),
            F.size(comments).cast("bigint").alias("comment_lines"),
            (F.size(nonblank) - F.size(comments)).cast("bigint").alias("code_lines"),
            F.coalesce(F.floor(indent / step), F.lit(0)).cast("int").alias("max_indentation")]


def file_metrics(contents: DataFrame) -> DataFrame:
    """(repo, path, file_seq, language, lines, blank_lines, comment_lines,
    code_lines, max_indentation) for non-empty files with a known language."""
    lang = lookup(rules.LANGUAGE_EXTENSIONS, S.suffix("path"))
    base = (contents.select("repo", "path", "file_seq", "content", lang.alias("language"))
                    .where(F.col("language").isNotNull() & (F.length("content") > 0))
                    .select("repo", "path", "file_seq", "language", lines_of("content").alias("_lines")))
    return base.select("repo", "path", "file_seq", "language",
                       *metric_columns(F.col("_lines"), F.col("language")))


def code_metrics_totals(fm: DataFrame) -> DataFrame:
    """Per repo: sums of every line class and the share of each."""
    t = fm.groupBy("repo").agg(
        F.sum("lines").alias("total_lines"), F.sum("code_lines").alias("code_lines"),
        F.sum("comment_lines").alias("comment_lines"), F.sum("blank_lines").alias("blank_lines"),
        F.count(F.lit(1)).alias("files_analyzed"))
    return t.select("*",
                    safe_percentage("code_lines", "total_lines").alias("code_pct"),
                    safe_percentage("comment_lines", "total_lines").alias("comment_pct"),
                    safe_percentage("blank_lines", "total_lines").alias("blank_pct"))


def code_metrics_by_language(fm: DataFrame) -> DataFrame:
    """(repo, language, files, lines, code_lines, comment_lines)."""
    return fm.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"),
        F.sum("code_lines").alias("code_lines"), F.sum("comment_lines").alias("comment_lines"))


def large_files(fm: DataFrame, min_lines: int = rules.LARGE_FILE_LINES) -> DataFrame:
    return fm.where(F.col("lines") > min_lines).select("repo", "path", "file_seq", "lines")


def deeply_nested_files(fm: DataFrame, level: int = rules.DEEP_NESTING_LEVEL) -> DataFrame:
    return fm.where(F.col("max_indentation") > level).select("repo", "path", "file_seq", "max_indentation")


def max_indentation(contents: DataFrame) -> DataFrame:
    return file_metrics(contents).select("repo", "path", "file_seq", "language", "max_indentation")


# Python's str.splitlines() boundaries
SPLITLINES = "\\r\\n|[\\n\\r\\x{B}\\x{C}\\x{1C}\\x{1D}\\x{1E}\\x{85}\\x{2028}\\x{2029}]"


def splitlines(col: Column) -> Column:
    """str.splitlines(): no final empty line, and [] for ''."""
    parts = F.split(col, SPLITLINES, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def basic_line_metrics(contents: DataFrame) -> DataFrame:
    """Clone-flow per-file lines (comment = stripped line starts with '#' or
    '//') and ``size`` in characters: all that flow reads of a text."""
    lang = S.expr(f"coalesce({S.map_lookup(rules.CODE_EXTENSIONS, S.suffix('path'))}, 'Unknown')")
    base = contents.select("repo", "path", "file_seq", lang.alias("language"),
                           F.length("content").cast("bigint").alias("size"), splitlines(F.col("content")).alias("_lines"))
    nonblank = F.filter("_lines", lambda l: ~is_blank(l))
    comments = F.filter(nonblank, lambda l: l.rlike(f"^{WS}*(?:#|//)"))
    return base.select(
        "repo", "path", "file_seq", "language", "size",
        F.size("_lines").cast("bigint").alias("lines"),
        (F.size("_lines") - F.size(nonblank)).cast("bigint").alias("blank_lines"),
        F.size(comments).cast("bigint").alias("comment_lines"),
        (F.size(nonblank) - F.size(comments)).cast("bigint").alias("code_lines"))


def code_metrics_basic(contents: DataFrame) -> DataFrame:
    """Clone flow per (repo, language) with real per-language sums
    (the original's running-total numbers are a known defect, fixed here)."""
    return code_metrics_by_language(basic_line_metrics(contents))


def content_volume(retrieved: DataFrame, analysed: DataFrame) -> DataFrame:
    """Per repo: files retrieved and analysed, coverage %, total characters of
    the retrieved text and average characters per analysed file."""
    r = retrieved.groupBy("repo").agg(F.count(F.lit(1)).alias("files_retrieved"),
                                      F.sum(F.length("content")).cast("bigint").alias("total_chars"))
    a = analysed.groupBy("repo").agg(F.count(F.lit(1)).alias("files_analyzed"))
    j = r.join(a, "repo", "left").fillna(0, ["files_analyzed"])
    return j.select(
        "repo", "files_retrieved", "files_analyzed", "total_chars",
        safe_percentage("files_analyzed", "files_retrieved").alias("coverage_pct"),
        F.when(F.col("files_analyzed") > 0, F.col("total_chars") / F.col("files_analyzed"))
         .alias("avg_chars_per_file"))
