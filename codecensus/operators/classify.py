"""§2.2 Path projections, filters and classification.

All operators here are narrow (map-only) except ``limit_files``, which ranks a
repository's files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions import sql as S
from codecensus.functions.paths import directory_of, name_of, parent_name_of, parts_of, suffix_of
from codecensus.functions.ranks import gapless_rank


def lit_map(d: dict) -> Column:
    """A literal map for dictionary lookups: no join, evaluated in codegen."""
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def lookup(d: dict, key: Column | str) -> Column:
    """Dictionary lookup; ``key`` may be SQL text (one cached expression)."""
    if isinstance(key, str):
        return S.expr(S.map_lookup(d, key))
    return F.try_element_at(lit_map(d), key)


def language_of(path: str = "path", vocabulary: dict | None = None) -> Column:
    return lookup(rules.LANGUAGE_EXTENSIONS if vocabulary is None else vocabulary, S.suffix(path))


def code_language_of(path: str = "path") -> Column:
    return lookup(rules.CODE_EXTENSIONS, S.suffix(path))


def in_list(col: Column, values) -> Column:
    return col.isin(list(values))


def with_path_parts(files: DataFrame) -> DataFrame:
    """name, lower-cased suffix, directory ('root' at top), parts, depth, parent."""
    out = files if "name" in files.columns else files.withColumn("name", name_of("path"))
    return (out.withColumn("suffix", suffix_of("path"))
               .withColumn("directory", directory_of("path"))
               .withColumn("parts", parts_of("path"))
               .withColumn("depth", (F.size(parts_of("path")) - 1).cast("int"))
               .withColumn("parent", parent_name_of("path")))


def detect_language(files: DataFrame, vocabulary: dict | None = None) -> DataFrame:
    """suffix -> language (42-entry map by default); NULL when unknown."""
    return files.withColumn("language", language_of("path", vocabulary))


def config_purpose(files: DataFrame) -> DataFrame:
    """Exact file name -> purpose; only configuration files are kept."""
    return (files.withColumn("purpose", lookup(rules.CONFIG_FILES, S.name("path")))
                 .where(F.col("purpose").isNotNull()))


def category_flag_sql(path: str = "path") -> dict[str, str]:
    """SQL text of the five independent category tests."""
    n = S.name(path)
    ln = f"lower({n})"
    lp = f"lower({path})"
    return {
        "source": f"({S.ends_with_any(n, rules.LANGUAGE_EXTENSIONS.keys())} AND NOT contains({lp}, 'test') "
                  f"AND NOT contains({ln}, 'config') AND NOT startswith({n}, '.'))",
        "test": f"({S.contains_any(lp, rules.TEST_PATH_WORDS)} OR {S.contains_any(ln, rules.TEST_NAME_WORDS)})",
        "config": f"({S.in_list(n, rules.CONFIG_FILES.keys())} OR {S.contains_any(ln, rules.CONFIG_NAME_WORDS)})",
        "documentation": f"({S.contains_any(ln, rules.DOC_NAME_WORDS)} OR {S.ends_with_any(n, rules.DOC_ENDINGS)})",
        "build": f"({S.contains_any(ln, rules.BUILD_NAME_WORDS)} OR {S.ends_with_any(n, rules.BUILD_ENDINGS)})",
    }


def category_flags(path: str = "path") -> dict[str, Column]:
    """The five independent category tests of the structure analysis."""
    return {k: S.expr(v) for k, v in category_flag_sql(path).items()}


def classify_files(files: DataFrame) -> DataFrame:
    """Adds is_source, is_test, is_config, is_documentation, is_build."""
    flags = category_flags("path")
    return files.select("*", *[flags[c].alias(f"is_{c}") for c in rules.CATEGORIES])


def basic_category_flags(path: str = "path") -> dict[str, Column]:
    """The clone flow's simpler rules."""
    lp = f"lower({path})"
    return {k: S.expr(v) for k, v in {
        "source": f"({S.map_lookup(rules.CODE_EXTENSIONS, S.suffix(path))} IS NOT NULL)",
        "test": f"(contains({lp}, 'test') OR startswith({lp}, 'tests') OR contains({lp}, '/tests/'))",
        "config": S.contains_any(lp, rules.BASIC_CONFIG_MARKERS),
        "documentation": S.contains_any(lp, rules.BASIC_DOC_MARKERS),
        "build": S.contains_any(path, rules.BASIC_BUILD_MARKERS),
    }.items()}


def classify_files_basic(contents: DataFrame) -> DataFrame:
    flags = basic_category_flags("path")
    return contents.select("*", *[flags[c].alias(f"is_{c}") for c in rules.CATEGORIES])


def filter_keep_sql(dirs, exts, max_size: int | None, hidden, path: str = "path") -> str:
    n = S.name(path)
    fits = "" if max_size is None else f"AND coalesce(size, 0) <= {int(max_size)} "
    return (f"(type = 'file' AND NOT arrays_overlap(split({path}, '/'), array("
            + ", ".join(S.q(d) for d in dirs) + f")) AND NOT {S.in_list(S.suffix(path), exts)} "
            + fits +
            f"AND NOT (startswith({n}, '.') AND NOT {S.in_list(n, hidden)}))")


def filter_files(files: DataFrame,
                 excluded_dirs=None, excluded_exts=None,
                 max_size: int | None = None,
                 hidden_allowed=None) -> DataFrame:
    """Keep relevant files: type 'file', no excluded part or extension, no
    hidden name except the allowed ones, and no file over ``max_size`` bytes
    if one is given. Pure filter, pushed below joins."""
    dirs = tuple(rules.EXCLUDED_DIRS if excluded_dirs is None else excluded_dirs)
    exts = tuple(rules.EXCLUDED_EXTENSIONS if excluded_exts is None else excluded_exts)
    hidden = tuple(rules.HIDDEN_ALLOWED if hidden_allowed is None else hidden_allowed)
    return files.where(S.expr(filter_keep_sql(dirs, exts, max_size, hidden)))


def priority_sql(path: str = "path") -> str:
    ln = f"lower({S.name(path)})"
    ext = S.suffix(path)
    w = rules.PRIORITY_WEIGHTS
    return S.points([
        (S.in_list(ln, rules.PRIORITY_KEY_NAMES), w["key"]),
        (S.contains_any(ln, rules.PRIORITY_CONFIG_WORDS), w["config"]),
        (S.in_list(ext, rules.PRIORITY_SOURCE_EXTS), w["source"]),
        (S.contains_any(ln, rules.PRIORITY_TEST_WORDS), w["test"]),
        (S.in_list(ext, rules.PRIORITY_DOC_EXTS), w["doc"]),
        (f"NOT contains({path}, '/')", w["root"]),
    ])


def priority_score(path: str = "path") -> Column:
    """Additive importance used when a listing must be cut."""
    return S.expr(priority_sql(path))


def with_priority_score(files: DataFrame) -> DataFrame:
    return files.withColumn("priority", priority_score("path"))


def limit_files(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Adds ``priority`` and ``rank``: the file's place in its repository by
    priority, ties in listing order. Every file comes back; with
    ``max_files`` only that many of each repository do.

    Ranks of whole repositories are made lane by lane; with a limit Spark
    keeps each map task's top N before the shuffle.
    """
    scored = files.withColumn("priority", priority_score("path"))
    if max_files is None:
        return gapless_rank(scored, ["repo"], F.struct((-F.col("priority")).alias("p"), "file_seq"))
    w = Window.partitionBy("repo").orderBy(F.col("priority").desc(), F.col("file_seq"))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= max_files)
