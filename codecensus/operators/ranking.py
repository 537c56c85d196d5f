"""§2.7 File ranking and selection.

Text is reduced to a line count inside its own row first; every window then
runs over narrow columns and is a ``row_number() <= N`` (window group limit,
computed partially per map task), so no repository's file list is gathered
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions.text import lines_of
from codecensus.functions import sql as S
from codecensus.operators.classify import lookup

KEY_CLASSES = [c for c, _ in rules.KEY_QUOTAS]


def _line_count(content: Column) -> Column:
    """len(text.split('\\n')); a file without text counts 1 line."""
    return F.coalesce(F.size(lines_of(content)), F.lit(1))


def key_file_class_sql(path: str = "path") -> str:
    ln = f"lower({S.name(path)})"
    return S.case_first([
        (S.in_list(ln, rules.KEY_MAIN_NAMES), "'main'"),
        (S.in_list(ln, rules.KEY_CONFIG_NAMES), "'config'"),
        (S.contains_any(ln, rules.KEY_CORE_WORDS), "'core'"),
        (S.contains_any(ln, rules.KEY_API_WORDS), "'api'"),
    ])


def key_files(listing_text: DataFrame, order_col: str = "file_seq") -> DataFrame:
    """(repo, pos, path, kind): the files chosen for explanation.

    main/config/core/api by first matching class with quotas 2/2/3/3 in
    listing order, then up to 5 other .py/.js/.ts/.java/.go files whose line
    count is nearest 100; finally only files with text are kept.
    ``listing_text`` holds the relevant listing with ``content`` (NULL when
    the text was not fetched).
    """
    return _key_files(listing_text.select(
        "repo", "path", F.col(order_col).alias("seq"), _line_count(F.col("content")).alias("lines"),
        F.col("content").isNotNull().alias("has_text")))


def key_files_from(features: DataFrame) -> DataFrame:
    """``key_files`` over per-file features (``n_lines``, ``has_text``): no text."""
    return _key_files(features.select("repo", "path", F.col("file_seq").alias("seq"),
                                      F.coalesce(F.col("n_lines"), F.lit(1)).alias("lines"), "has_text"))


def _key_files(narrow: DataFrame) -> DataFrame:
    quota = F.create_map(*[x for c, q in rules.KEY_QUOTAS for x in (F.lit(c), F.lit(q))])
    class_idx = F.create_map(*[x for i, c in enumerate(KEY_CLASSES) for x in (F.lit(c), F.lit(i))])
    narrow = narrow.select("*", S.expr(key_file_class_sql("path")).alias("kind"),
                           S.expr(S.in_list(S.suffix("path"), rules.KEY_EXTRA_SUFFIXES)).alias("extra_ok"))
    max_q = max(q for _, q in rules.KEY_QUOTAS)
    wc = Window.partitionBy("repo", "kind").orderBy("seq")
    chosen = (narrow.where(F.col("kind").isNotNull())
                    .withColumn("rank", F.row_number().over(wc))
                    .where(F.col("rank") <= max_q)
                    .where(F.col("rank") <= F.element_at(quota, F.col("kind")))
                    .select("repo", "path", "seq", "kind", "rank", "has_text",
                            F.element_at(class_idx, F.col("kind")).alias("k")))
    # top (5 + all quota slots) candidates always contain the 5 best unchosen
    n_slots = rules.KEY_EXTRA_COUNT + sum(q for _, q in rules.KEY_QUOTAS)
    dist = F.abs(F.col("lines") - rules.KEY_EXTRA_TARGET_LINES)
    we = Window.partitionBy("repo").orderBy(dist, F.col("seq"))
    cand = (narrow.where(F.col("extra_ok"))
                  .withColumn("rank", F.row_number().over(we))
                  .where(F.col("rank") <= n_slots))
    extra = (cand.join(chosen.select("repo", "path"), ["repo", "path"], "left_anti")
                 .withColumn("rank", F.row_number().over(we))
                 .where(F.col("rank") <= rules.KEY_EXTRA_COUNT)
                 .select("repo", "path", "seq", F.lit("extra").alias("kind"), "rank", "has_text",
                         F.lit(len(KEY_CLASSES)).alias("k")))
    picked = chosen.unionByName(extra).where(F.col("has_text"))
    wp = Window.partitionBy("repo").orderBy("k", "rank")
    return picked.select("repo", F.row_number().over(wp).alias("pos"), "path", "kind")


def selection_score_sql(path: str = "path", lines: str = "lines", keyword: str = "has_keyword",
                        focus: str = "is_focus") -> str:
    """Additive score used to pick files for explanation (SQL text) over the
    per-file features ``lines`` and ``has_keyword``."""
    ln = f"lower({S.name(path)})"
    (lo1, hi1, p1), (lo2, hi2, p2) = rules.SEL_SIZE_BANDS
    base = S.points([
        (f"coalesce({focus}, false)", rules.SEL_FOCUS),
        (S.in_list(ln, rules.SEL_MAIN_NAMES), rules.SEL_MAIN),
        (S.contains_any(ln, rules.SEL_CORE_WORDS), rules.SEL_CORE),
        (S.in_list(ln, rules.SEL_CONFIG_NAMES), rules.SEL_CONFIG),
        (S.contains_any(ln, rules.SEL_UTIL_WORDS), rules.SEL_UTIL),
        (S.contains_any(ln, rules.SEL_API_WORDS), rules.SEL_API),
        (S.contains_any(ln, rules.SEL_MODEL_WORDS), rules.SEL_MODEL),
        (S.contains_any(ln, rules.SEL_TEST_WORDS), rules.SEL_TEST),
        (f"{S.map_lookup(rules.CODE_EXTENSIONS, S.suffix(path))} IS NOT NULL", rules.SEL_CODE_EXT),
        (keyword, rules.SEL_KEYWORD),
        (f"NOT contains({path}, '/')", rules.SEL_ROOT),
    ])
    size_pts = (f"(CASE WHEN {lines} BETWEEN {lo1} AND {hi1} THEN {p1} WHEN {lines} BETWEEN {lo2} AND {hi2} "
                f"THEN {p2} WHEN {lines} > {hi2} THEN {rules.SEL_SIZE_LARGE} ELSE 0 END)")
    return f"({base} + {size_pts})"


def selection_features(contents: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Eligible code files reduced to (repo, path, file_seq, lines, has_keyword):
    the text is read here, inside its own row, and dropped."""
    eligible = contents.where(lookup(rules.CODE_EXTENSIONS, S.suffix("path")).isNotNull()
                              & F.col("content").isNotNull())
    if max_chars is not None:
        eligible = eligible.where(F.length("content") <= max_chars)
    return eligible.select("repo", "path", "file_seq",
                           S.expr("size(split(content, '\\n', -1))").alias("lines"),
                           S.expr(S.contains_any("lower(content)", rules.SEL_KEYWORDS)).alias("has_keyword"))


def _with_focus(contents: DataFrame, focus: DataFrame | None) -> DataFrame:
    if focus is None:
        return contents.withColumn("is_focus", F.lit(False))
    f = focus.select("repo", "path").distinct().withColumn("is_focus", F.lit(True))
    return contents.join(f, ["repo", "path"], "left")


def select_from_features(features: DataFrame, focus: DataFrame | None = None,
                         n: int = rules.MAX_FILES_FOR_ANALYSIS,
                         max_chars: int | None = None) -> DataFrame:
    """``select_for_analysis`` over per-file features (``chars``, ``n_lines``,
    ``has_keyword``): no text."""
    eligible = features.where(lookup(rules.CODE_EXTENSIONS, S.suffix("path")).isNotNull() & F.col("has_text"))
    if max_chars is not None:
        eligible = eligible.where(F.col("chars") <= max_chars)
    return _select(eligible.select("repo", "path", "file_seq", F.col("n_lines").alias("lines"), "has_keyword"),
                   focus, n)


def _select(feats: DataFrame, focus: DataFrame | None, n: int) -> DataFrame:
    scored = _with_focus(feats, focus).select(
        "repo", "path", "file_seq", S.expr(selection_score_sql()).alias("score"))
    w = Window.partitionBy("repo").orderBy(F.col("score").desc(), F.col("file_seq"))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                  .select("repo", "rank", "path", "file_seq", "score"))


def select_for_analysis(contents: DataFrame, focus: DataFrame | None = None,
                        n: int = rules.MAX_FILES_FOR_ANALYSIS,
                        max_chars: int | None = None) -> DataFrame:
    """(repo, rank, path, file_seq, score): top N code files by score, ties in
    file order; with ``max_chars`` only files of at most that length. The focus join and
    the ranking see only narrow per-file features, never the text."""
    return _select(selection_features(contents, max_chars), focus, n)


def reduced_selection_score_sql(path: str = "path", focus: str = "is_focus") -> str:
    ln = f"lower({S.name(path)})"
    return S.points([
        (f"coalesce({focus}, false)", rules.SEL_FOCUS),
        (S.in_list(ln, rules.SEL_MAIN_NAMES), rules.SEL_MAIN),
        (S.contains_any(ln, rules.SEL_CORE_WORDS), rules.SEL_CORE),
        (S.contains_any(ln, rules.SEL_API_WORDS), rules.SEL_API),
        (f"{S.map_lookup(rules.CODE_EXTENSIONS, S.suffix(path))} IS NOT NULL", rules.SEL_CODE_EXT),
        (f"NOT contains({path}, '/')", rules.SEL_ROOT),
    ])


def selection_scores(contents: DataFrame, focus: DataFrame | None = None,
                     n: int = rules.SELECTION_SHOWN) -> DataFrame:
    """(repo, rank, path, score, selected, total_files, selected_files): the
    reduced score's top N with the real selection marked."""
    selected = select_for_analysis(contents, focus).select("repo", "path", F.lit(True).alias("selected"))
    narrow = contents.select("repo", "path", "file_seq")
    scored = _with_focus(narrow, focus).select(
        "repo", "path", "file_seq", S.expr(reduced_selection_score_sql()).alias("score"))
    w = Window.partitionBy("repo").orderBy(F.col("score").desc(), F.col("file_seq"))
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    totals = narrow.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files"))
    sel_n = selected.groupBy("repo").agg(F.count(F.lit(1)).alias("selected_files"))
    return (top.join(selected, ["repo", "path"], "left").join(totals, "repo").join(sel_n, "repo", "left")
               .select("repo", "rank", "path", "score", F.coalesce("selected", F.lit(False)).alias("selected"),
                       "total_files", F.coalesce("selected_files", F.lit(0)).alias("selected_files")))


def report_importance_sql(path: str = "path") -> str:
    ln = f"lower({S.name(path)})"
    return S.case_first([
        (S.in_list(ln, rules.ORDER_MAIN_NAMES), "1"),
        (S.in_list(ln, rules.ORDER_CONFIG_NAMES), "2"),
        (S.contains_any(ln, rules.ORDER_CORE_WORDS), "3"),
        (S.contains_any(ln, rules.ORDER_API_WORDS), "4"),
    ], "5")


def report_file_order(explanations: DataFrame, order_col: str = "file_seq") -> DataFrame:
    """(repo, path, importance, order_key): sort key for the report's file
    sections (importance 1..5, then explanation order). A per-repo position
    is ``row_number`` over this key where a bounded section is rendered."""
    return explanations.select("repo", "path", S.expr(report_importance_sql()).alias("importance"),
                               F.col(order_col).alias("order_key"))
