"""§2.6 Pattern and technology detection.

Every rule is a keyword test on one file's path, name or lower-cased text,
and every repository-level answer is an OR over its files. So all rules are
computed in ONE partial aggregation: each file's text is lower-cased once,
tested for every term, and the per-repo ``bool_or`` flags are combined map-
side before the shuffle. The four results (project type, architecture, API
type, technologies) are projections of that single flag row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions import sql as S


def _terms() -> list[str]:
    terms: list[str] = []
    for _, group in rules.TECHNOLOGY_GROUPS:
        for pats in group.values():
            terms += pats
    for _, pats in rules.API_TYPE_RULES:
        terms += pats
    terms += rules.EVENT_WORDS
    terms += [w for w, _ in rules.PYTHON_WEB_RULES]
    seen: list[str] = []
    for t in terms:
        if t not in seen:
            seen.append(t)
    return seen


TERMS = _terms()


FLAG_OF = {t: f"t{i}" for i, t in enumerate(TERMS)}


def term_hit_sql() -> list[str]:
    """Per-file keyword hits (SQL text) over ``lc`` = lower(text): one
    boolean per term plus the two root package.json tests."""
    return ([f"contains(lc, {S.q(t)}) AS {FLAG_OF[t]}" for t in TERMS]
            + [f"(path = 'package.json' AND {S.contains_any('lc', rules.FRONTEND_MARKERS)}) AS pkg_frontend",
               f"(path = 'package.json' AND {S.contains_any('lc', rules.BACKEND_MARKERS)}) AS pkg_backend"])


def pattern_flag_sql(from_hits: bool = False) -> list[str]:
    """Aggregate expressions (SQL text) over rows with ``lc`` = lower(text),
    or over per-file hit columns (``term_hit_sql``) when ``from_hits``."""
    n = S.name("path")
    if from_hits:
        aggs = [f"bool_or({FLAG_OF[t]}) AS {FLAG_OF[t]}" for t in TERMS]
        aggs += ["bool_or(pkg_frontend) AS pkg_frontend", "bool_or(pkg_backend) AS pkg_backend"]
    else:
        aggs = [f"bool_or(contains(lc, {S.q(t)})) AS {FLAG_OF[t]}" for t in TERMS]
        aggs += [
            f"bool_or(path = 'package.json' AND {S.contains_any('lc', rules.FRONTEND_MARKERS)}) AS pkg_frontend",
            f"bool_or(path = 'package.json' AND {S.contains_any('lc', rules.BACKEND_MARKERS)}) AS pkg_backend"]
    aggs += [
        f"bool_or({n} = 'package.json') AS has_package_json",
        f"bool_or({S.in_list(n, rules.PYTHON_MANIFESTS)}) AS has_python_manifest",
        f"bool_or({S.in_list(n, rules.MOBILE_MANIFESTS)}) AS has_mobile_manifest",
        f"bool_or({S.in_list(n, rules.JAVA_MANIFESTS)}) AS has_java_manifest",
        *[f"bool_or({n} = {S.q(f)}) AS has_{i}" for i, (f, _) in enumerate(rules.SINGLE_MANIFEST_TYPES)],
        f"bool_or({S.in_list(n, rules.CONTAINER_FILES)}) AS has_container",
        f"bool_or({S.in_list(S.raw_suffix('path'), rules.DOC_SITE_SUFFIXES)}) AS has_doc_suffix",
        f"count_if({S.in_list(S.raw_suffix('path'), rules.DOC_SITE_CODE_SUFFIXES)}) AS n_code_suffix",
        *[f"bool_or({S.in_list(S.parent('path'), dirs)}) AS arch_dir_{i}"
          for i, (_, dirs) in enumerate(rules.ARCHITECTURE_DIR_RULES)],
        f"bool_or({n} = {S.q(rules.MICROSERVICES_FILE)}) AS has_compose",
        f"bool_or({S.in_list(n, rules.API_FIRST_FILES)}) AS has_api_spec",
    ]
    return aggs


def pattern_flags(listing_text: DataFrame) -> DataFrame:
    """One row per repository with every flag the four detectors need.

    Input: the relevant files with (repo, path, content) — content may be
    NULL for files whose text was not fetched. The text is lower-cased once
    per file; each term is one ``contains`` in a single partial aggregation.
    """
    lc = F.lower(F.coalesce(F.col("content"), F.lit(""))).alias("lc")
    return (listing_text.select("repo", "path", lc)
                        .groupBy("repo").agg(*[S.expr(a) for a in pattern_flag_sql()]))


def pattern_flags_from_hits(features: DataFrame) -> DataFrame:
    """``pattern_flags`` from per-file hit columns (no text)."""
    return features.groupBy("repo").agg(*[S.expr(a) for a in pattern_flag_sql(from_hits=True)])


def term_hit_columns() -> list[Column]:
    """Per-file hit columns; the row needs ``lc`` (lower-cased text) and ``path``."""
    return [S.expr(x) for x in term_hit_sql()]


def _any(terms) -> Column:
    out = None
    for t in terms:
        c = F.col(FLAG_OF[t])
        out = c if out is None else (out | c)
    return out


def project_type_expr() -> Column:
    e = F.when(F.col("has_package_json"),
               F.when(F.col("pkg_frontend"), "Frontend Web Application")
                .when(F.col("pkg_backend"), "Backend Web Application")
                .otherwise("Node.js Application"))
    py = None
    for term, label in rules.PYTHON_WEB_RULES:
        py = F.when(F.col(FLAG_OF[term]), label) if py is None else py.when(F.col(FLAG_OF[term]), label)
    e = e.when(F.col("has_python_manifest"), py.otherwise("Python Application"))
    e = e.when(F.col("has_mobile_manifest"), "Mobile Application")
    e = e.when(F.col("has_java_manifest"), "Java Application")
    for i, (_, label) in enumerate(rules.SINGLE_MANIFEST_TYPES):
        e = e.when(F.col(f"has_{i}"), label)
    e = e.when(F.col("has_container"), "Containerized Application")
    e = e.when(F.col("has_doc_suffix") & (F.col("n_code_suffix") < rules.DOC_SITE_MAX_CODE_FILES),
               "Documentation/Static Site")
    return e.otherwise("Unknown")


def api_type_expr() -> Column:
    e = None
    for label, terms in rules.API_TYPE_RULES:
        e = F.when(_any(terms), label) if e is None else e.when(_any(terms), label)
    return e


def architecture_expr() -> Column:
    """Ordered array of detected architecture patterns."""
    conds = [F.col(f"arch_dir_{i}") for i in range(len(rules.ARCHITECTURE_DIR_RULES))]
    conds[1] = conds[1] | F.col("has_compose")
    labels = [label for label, _ in rules.ARCHITECTURE_DIR_RULES]
    conds += [F.col("has_api_spec"), _any(rules.EVENT_WORDS)]
    labels += ["API-First Design", "Event-Driven Architecture"]
    return F.array_compact(F.array(*[F.when(c, F.lit(lb)) for c, lb in zip(conds, labels)]))


def technologies_expr(group: dict) -> Column:
    return F.array_compact(F.array(*[F.when(_any(pats), F.lit(tech)) for tech, pats in group.items()]))


def detect_project_type(flags: DataFrame) -> DataFrame:
    return flags.select("repo", project_type_expr().alias("project_type"))


def detect_api_type(flags: DataFrame) -> DataFrame:
    return flags.select("repo", api_type_expr().alias("api_type"))


def detect_architecture(flags: DataFrame) -> DataFrame:
    """(repo, pos, pattern) in rule order."""
    return (flags.select("repo", F.posexplode(architecture_expr()).alias("pos", "pattern"))
                 .select("repo", F.col("pos").cast("int"), "pattern"))


def detect_technologies(flags: DataFrame) -> DataFrame:
    """(repo, category, pos, technology) in rule order within each category."""
    groups = F.array(*[F.struct(F.lit(cat).alias("category"), technologies_expr(g).alias("techs"))
                       for cat, g in rules.TECHNOLOGY_GROUPS])
    return (flags.select("repo", F.explode(groups).alias("g"))
                 .select("repo", F.col("g.category").alias("category"),
                         F.posexplode("g.techs").alias("pos", "technology"))
                 .select("repo", "category", F.col("pos").cast("int"), "technology"))


def project_patterns(flags: DataFrame) -> DataFrame:
    """One row per repository: the four detectors side by side (arrays)."""
    return flags.select(
        "repo", project_type_expr().alias("project_type"), api_type_expr().alias("api_type"),
        architecture_expr().alias("architecture_patterns"),
        *[technologies_expr(g).alias(cat) for cat, g in rules.TECHNOLOGY_GROUPS])
