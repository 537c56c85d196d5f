"""§2.9 Report tables and documents.

Report tables are per-repo aggregates. Documents are built as per-repo text
blocks: every list inside a block comes from rows that are either capped
(top-N through a window group limit) or are the block's own content (for
example the documentation files of one repository), gathered with
``collect_list`` per repository and ordered inside the row. Blocks are joined
on ``repo`` and concatenated; nothing passes through the driver.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecensus import report_text as T
from codecensus import rules
from codecensus.functions import json_text as J
from codecensus.functions.ranks import gapless_rank
from codecensus.functions.text import contains_any, fmt1, format_size, safe_percentage
from codecensus.operators.classify import category_flags
from codecensus.operators.explanations import code_analysis_overview

FEATURES = ["has_issues", "has_projects", "has_wiki"]
_PH = re.compile(r"\{(\w+)\}")


@lru_cache(maxsize=None)
def _lit(text: str) -> Column:
    return F.lit(text)


def fill(template: str, **values) -> Column:
    """Template with {name} placeholders -> concat of literals and columns
    (a NULL value prints as 'None', like an f-string)."""
    parts: list[Column] = []
    pos = 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            parts.append(_lit(template[pos:m.start()]))
        v = values[m.group(1)]
        parts.append(F.coalesce(v.cast("string"), _lit("None")) if isinstance(v, Column) else _lit(str(v)))
        pos = m.end()
    if pos < len(template):
        parts.append(_lit(template[pos:]))
    return F.concat(*parts) if parts else _lit("")


def thousands(c: Column) -> Column:
    """'{:,}' for integers."""
    return F.format_number(c.cast("bigint"), 0)


def block(df: DataFrame, order: list[str], line: Column, alias: str, keys=("repo",)) -> DataFrame:
    """Rows -> one text per key: lines concatenated in ``order``."""
    s = df.select(*keys, F.struct(*[F.col(o) for o in order], line.alias("_l")).alias("_s"))
    return s.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["_l"]), "").alias(alias))


def _when_nonempty(text: Column, head: str, tail: str = "") -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(head), text, F.lit(tail))).otherwise(F.lit(""))


def format_size_table(totals: DataFrame) -> DataFrame:
    """(repo, total_size, size_text) with '0 B' / one decimal B, KB, MB, GB."""
    return totals.select("repo", "total_size", format_size(F.col("total_size")).alias("size_text"))


def safe_percentages(files: DataFrame) -> DataFrame:
    """(repo, test_files, total_files, test_pct): 0 when a repo has no files."""
    fl = category_flags("path")
    t = files.groupBy("repo").agg(F.count_if(fl["test"]).alias("test_files"), F.count(F.lit(1)).alias("total_files"))
    return t.select("*", safe_percentage("test_files", "total_files").alias("test_pct"))


def repo_file_stats(files: DataFrame) -> DataFrame:
    """Every per-repository counter the report reads from the listing, in ONE
    partial aggregation: totals, the five categories, CI files (two marker
    sets) and dependency manifests among configuration files."""
    fl = category_flags("path")
    lp = F.lower(F.col("path"))
    ci = fl["config"] & contains_any(lp, rules.CI_MARKERS)
    ci_narrow = fl["config"] & (F.col("path").contains(".github/workflows") | lp.contains("travis"))
    dep = fl["config"] & contains_any(lp, rules.DEP_MANIFEST_MARKERS)
    return files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum(F.coalesce(F.col("size"), F.lit(0))).cast("bigint").alias("total_size"),
        *[F.count_if(fl[c]).alias(f"n_{c}") for c in rules.CATEGORIES],
        F.count_if(ci).alias("n_ci"), F.count_if(ci_narrow).alias("n_ci_narrow"), F.count_if(dep).alias("n_dep"))


def fm_stats(fm: DataFrame) -> DataFrame:
    """Per-repo line totals, shares and complexity-indicator counts in one aggregation."""
    t = fm.groupBy("repo").agg(
        F.sum("lines").alias("total_lines"), F.sum("code_lines").alias("code_lines"),
        F.sum("comment_lines").alias("comment_lines"), F.sum("blank_lines").alias("blank_lines"),
        F.count(F.lit(1)).alias("files_analyzed"),
        F.count_if(F.col("lines") > rules.LARGE_FILE_LINES).alias("n_big"),
        F.count_if(F.col("max_indentation") > rules.DEEP_NESTING_LEVEL).alias("n_deep"))
    return t.select("*", safe_percentage("code_lines", "total_lines").alias("code_pct"),
                    safe_percentage("comment_lines", "total_lines").alias("comment_pct"),
                    safe_percentage("blank_lines", "total_lines").alias("blank_pct"))


def category_counts_from(stats: DataFrame) -> DataFrame:
    """(repo, category, files) from ``repo_file_stats`` (non-zero only)."""
    arr = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"n_{c}").alias("files")) for c in rules.CATEGORIES])
    return (stats.select("repo", F.explode(arr).alias("s"))
                 .select("repo", "s.category", "s.files").where(F.col("files") > 0))


def documentation_quality(files: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(repo, documentation_files, total_files, ratio, tier)."""
    if stats is None:
        fl = category_flags("path")
        t = files.groupBy("repo").agg(F.count_if(fl["documentation"]).alias("documentation_files"),
                                      F.count(F.lit(1)).alias("total_files"))
    else:
        t = stats.select("repo", F.col("n_documentation").alias("documentation_files"), "total_files")
    n = F.col("documentation_files")
    tier = None
    for bound, label in rules.DOC_TIERS:
        cond = (n == 0) if bound == 0 else (n < bound)
        tier = F.when(cond, F.lit(label)) if tier is None else tier.when(cond, F.lit(label))
    return t.select("*", safe_percentage(n, "total_files").alias("ratio"),
                    tier.otherwise(F.lit(rules.DOC_TIER_TOP)).alias("tier"))


def documentation_groups(files: DataFrame) -> DataFrame:
    """(repo, doc_group, file_seq, path): documentation files by group (groups
    overlap; files in none are 'Other')."""
    fl = category_flags("path")
    lp = F.lower(F.col("path"))
    groups = [F.when(contains_any(lp, words), F.lit(g)) for g, words in rules.DOC_GROUPS]
    arr = F.array_compact(F.array(*groups))
    docs = files.where(fl["documentation"]).select("repo", "file_seq", "path", arr.alias("g"))
    out = docs.select("repo", F.explode(F.when(F.size("g") > 0, F.col("g")).otherwise(F.array(F.lit("Other"))))
                      .alias("doc_group"), "file_seq", "path")
    return out


def workflow_summary(files: DataFrame, repos: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Per repo: number of CI files among configuration files, of test files
    (and their share) and of build files, and the repository's features."""
    st = repo_file_stats(files) if stats is None else stats
    feats = repos.select("repo", *[F.coalesce(f, F.lit(False)).alias(f) for f in FEATURES])
    return (st.join(feats, "repo", "left")
              .select("repo", F.col("n_ci").alias("ci_files"), F.col("n_test").alias("test_files"),
                      safe_percentage("n_test", "total_files").alias("test_pct"), F.col("n_build").alias("build_files"), *FEATURES))


def workflow_files(files: DataFrame, kind: str) -> DataFrame:
    """The ``ci`` or ``build`` files of the listing."""
    fl = category_flags("path")
    if kind == "build":
        return files.where(fl["build"])
    return files.where(fl["config"] & contains_any(F.lower(F.col("path")), rules.CI_MARKERS))


def development_workflow(files: DataFrame, repos: DataFrame, stats: DataFrame | None = None,
                         shown: int = rules.BUILD_FILES_SHOWN) -> DataFrame:
    """(repo, part, ord, path, n, pct, shown): all CI and build files, one row
    each in listing order, of which a display shows the first ones; a row
    ``ci``, ``test`` and ``build`` with the number (and share) of such files;
    a row for each feature the repository may have, ``n`` 1 if it has."""
    summary = workflow_summary(files, repos, stats)
    none = {"path": F.lit(None).cast("string"), "pct": F.lit(None).cast("double"), "shown": F.lit(None).cast("boolean")}

    def fact(part: str, n: Column, pct: Column = none["pct"]) -> Column:
        return F.struct(F.lit(part).alias("part"), n.cast("bigint").alias("n"), pct.alias("pct"))

    facts = F.array(fact("ci", F.col("ci_files")), fact("test", F.col("test_files"), F.col("test_pct")),
                    fact("build", F.col("build_files")), *[fact(f, F.coalesce(f, F.lit(False)).cast("int")) for f in FEATURES])
    out = summary.select("repo", F.explode(facts).alias("f")).select(
        "repo", "f.part", F.lit(0).cast("bigint").alias("ord"), none["path"].alias("path"), "f.n", "f.pct", none["shown"].alias("shown"))
    for kind in ("ci", "build"):
        ranked = gapless_rank(workflow_files(files, kind).select("repo", "file_seq", "path"), ["repo"], F.col("file_seq"))
        out = out.unionByName(ranked.select(
            "repo", F.lit(f"{kind}_file").alias("part"), F.col("rank").alias("ord"), "path", F.lit(None).cast("bigint").alias("n"),
            none["pct"].alias("pct"), (F.col("rank") <= shown).alias("shown")))
    return out


def suggestion_text(value: Column, is_string: Column) -> Column:
    """A suggestion as text: strings as given; objects by 'text', then
    'description' (of a repeated key the last), else their JSON; other values
    have none."""
    fields = F.from_json(value, "text string, description string", J.OPTIONS)
    return F.when(is_string, value).when(value.startswith("{"), F.coalesce(fields["text"], fields["description"], value))


def recommendation_inputs(files: DataFrame, fm: DataFrame, flags_arch: DataFrame,
                          items: DataFrame | None, stats: DataFrame | None = None,
                          fmstats: DataFrame | None = None) -> DataFrame:
    """One row per repo with every count the recommendation rules read."""
    st = repo_file_stats(files) if stats is None else stats
    fs = fm_stats(fm) if fmstats is None else fmstats
    s = st.select("repo", "total_files", F.col("n_documentation").alias("docs"), F.col("n_test").alias("tests"),
                  F.col("n_ci_narrow").alias("ci"), F.col("n_dep").alias("dep_files"))
    m = fs.select("repo", F.col("n_big").alias("large"), F.col("n_deep").alias("nested"))
    out = s.join(m, "repo", "left").join(flags_arch, "repo", "left")
    if items is not None:
        sug = items.where(F.col("field") == "improvement_suggestions").select(
            "repo", "file_seq", "pos", suggestion_text(F.col("value"), F.col("is_string")).alias("t"))
        lt = F.lower("t")

        def first(cond: Column) -> Column:
            return F.min(F.when(cond, F.struct("file_seq", "pos", "t")))["t"]

        ai = sug.groupBy("repo").agg(first(lt.contains("test")).alias("ai_test"),
                                     first(contains_any(lt, rules.AI_ERROR_WORDS)).alias("ai_error"),
                                     first(lt.contains("performance")).alias("ai_perf"))
        out = out.join(ai, "repo", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("string").alias(c) for c in ("ai_test", "ai_error", "ai_perf")])
    return out.fillna(0, ["large", "nested", "n_arch"])


def recommendations(inputs: DataFrame) -> DataFrame:
    """(repo, pos, text): the ordered recommendation rules; none -> 'all good'."""
    R = rules.RECOMMENDATIONS
    ratio = F.coalesce(F.try_divide(F.col("tests"), F.col("total_files")), F.lit(0.0))
    recs = F.array_compact(F.array(
        F.when(F.col("docs") < 3, F.lit(R["docs"])),
        F.when(ratio < rules.TEST_RATIO_MIN, F.lit(R["tests"])),
        F.when(F.col("large") > 0, fill(R["large"], n=F.col("large"))),
        F.when(F.col("nested") > 0, fill(R["nesting"], n=F.col("nested"))),
        F.when(F.col("n_arch") == 0, F.lit(R["architecture"])),
        F.when(F.col("ci") == 0, F.lit(R["ci"])),
        F.when(F.col("dep_files") == 0, F.lit(R["deps"])),
        F.when(F.col("ai_test").isNotNull(), F.concat(F.lit(R["ai_testing"]), F.col("ai_test"))),
        F.when(F.col("ai_error").isNotNull(), F.concat(F.lit(R["ai_error"]), F.col("ai_error"))),
        F.when(F.col("ai_perf").isNotNull(), F.concat(F.lit(R["ai_performance"]), F.col("ai_perf"))),
    ))
    recs = F.when(F.size(recs) > 0, recs).otherwise(F.array(F.lit(R["none"])))
    return (inputs.select("repo", F.posexplode(recs).alias("pos", "text"))
                  .select("repo", (F.col("pos") + 1).cast("int").alias("pos"), "text"))


def technology_stack(pattern_rows: DataFrame, managers: DataFrame, tooling: DataFrame) -> DataFrame:
    """(repo, section, pos, item): project type, the five technology groups,
    package managers (one per manifest, in file order) and tooling."""
    from codecensus.operators.patterns import project_type_expr, technologies_expr
    pt = pattern_rows.select("repo", F.lit("project_type").alias("section"), F.lit(0).cast("bigint").alias("pos"),
                             project_type_expr().alias("item"))
    groups = F.array(*[F.struct(F.lit(cat).alias("section"), technologies_expr(g).alias("items"))
                       for cat, g in rules.TECHNOLOGY_GROUPS])
    tech = (pattern_rows.select("repo", F.explode(groups).alias("g"))
                        .select("repo", F.col("g.section").alias("section"),
                                F.posexplode("g.items").alias("pos", "item"))
                        .select("repo", "section", F.col("pos").cast("bigint"), "item"))
    pm = managers.select("repo", F.lit("package_managers").alias("section"), F.col("file_seq").alias("pos"),
                         F.col("manager").alias("item"))
    tl = tooling.select("repo", F.col("category").alias("section"), F.col("rank").cast("bigint").alias("pos"),
                        F.col("tool").alias("item"))
    return pt.unionByName(tech).unionByName(pm).unionByName(tl)


def quick_summary(repos: DataFrame, files: DataFrame, basic: bool = False) -> DataFrame:
    """(repo, name, description, language, total_files, top_languages,
    size_text, documentation_files, test_files, config_files, document).

    ``basic`` takes the clone flow's vocabulary and category rules. One
    aggregation per (repo, language) feeds everything; a repository's row
    then gathers at most the vocabulary's languages.
    """
    from codecensus.operators.classify import basic_category_flags, language_of
    fl = basic_category_flags("path") if basic else category_flags("path")
    lang = language_of("path", rules.CODE_EXTENSIONS if basic else None)
    per = files.groupBy("repo", lang.alias("l")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("size", F.lit(0))).cast("bigint").alias("bytes"),
        F.min("file_seq").alias("first"),
        *[F.count_if(fl[c]).alias(c) for c in ("documentation", "test", "config")])
    found = F.array_sort(F.collect_list(F.when(F.col("l").isNotNull(), F.struct(
        (-F.col("n")).alias("order"), "first", "l", "n"))))
    t = per.groupBy("repo").agg(
        F.sum("n").alias("total_files"), F.sum("bytes").alias("total_size"),
        *[F.sum(c).alias(f"{c}_files") for c in ("documentation", "test", "config")],
        F.slice(found, 1, rules.TOP_QUICK_LANGUAGES).alias("top"))
    r = repos.select("repo", F.coalesce("repo", F.lit(T.QUICK_DEFAULT_NAME)).alias("name"),
                     F.coalesce("description", F.lit(T.QUICK_DEFAULT_DESCRIPTION)).alias("description"),
                     F.coalesce("language", F.lit(T.QUICK_DEFAULT_LANGUAGE)).alias("language"))
    j = t.join(r, "repo", "left").fillna({"name": T.QUICK_DEFAULT_NAME, "description": T.QUICK_DEFAULT_DESCRIPTION,
                                          "language": T.QUICK_DEFAULT_LANGUAGE})
    lines = F.array_join(F.transform("top", lambda x: fill(T.QUICK_LANGUAGE_LINE, language=x["l"], files=x["n"])), "")
    size_text = format_size(F.col("total_size"))
    doc = F.concat(
        fill(T.QUICK, name=F.col("name"), description=F.col("description"), language=F.col("language"),
             total_files=thousands(F.col("total_files"))),
        lines,
        fill(T.QUICK_STATS, size=size_text, docs=F.col("documentation_files"), tests=F.col("test_files"),
             configs=F.col("config_files")))
    tops = F.transform("top", lambda x: F.concat(x["l"], F.lit(":"), x["n"].cast("string")))
    return j.select("repo", "name", "description", "language", "total_files", tops.alias("top_languages"),
                    size_text.alias("size_text"), "documentation_files", "test_files", "config_files",
                    doc.alias("document"))


def build_run_guide(collected: DataFrame) -> DataFrame:
    """(repo, sections, guide): Docker, npm, Python and Make sections chosen by
    path rules over the collected files."""
    lp = F.lower(F.col("path"))
    flags = collected.groupBy("repo").agg(
        F.bool_or(lp.contains("dockerfile")).alias("docker"),
        F.bool_or(lp.endswith("package.json")).alias("npm"),
        F.bool_or(lp.endswith("requirements.txt")).alias("python"),
        F.bool_or(lp.endswith("makefile") | (F.col("path") == "Makefile")).alias("make"))
    parts = [F.when(F.col(k), F.lit(head + "\n" + body)) for k, head, body in T.GUIDE_SECTIONS]
    names = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k, _, _ in T.GUIDE_SECTIONS]))
    guide = F.concat_ws("\n", fill(T.GUIDE_HEADER, repo=F.col("repo")), *parts)
    return flags.select("repo", F.array_join(names, "|").alias("sections"), guide.alias("guide"))


# ---------------------------------------------------------------- documents
# A document is a set of line-aligned fragments (repo, part, ord, text) per
# section. Lists that grow with a repository's own files (documentation
# files, CI files, manifests) stay one row per line; every other block is a
# single fragment built from capped lists.
LAST = 1 << 62
FRAGMENT = ["repo", "part", "ord", "text"]


def one_fragment(df: DataFrame, text: Column, part: int = 0) -> DataFrame:
    return df.select("repo", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("ord"), text.alias("text"))


def list_fragments(rows: DataFrame, part: int, head: str, line: Column, tail: str = "\n",
                   order: str = "file_seq") -> DataFrame:
    """A head line, one fragment per row (ordered by ``order``) and a tail;
    heads and tails exist only for repositories with rows."""
    def end(at: int, text: str) -> Column:
        return F.struct(F.lit(at).cast("bigint").alias("ord"), F.lit(text).alias("text"))

    ends = rows.select("repo").distinct().select("repo", F.explode(F.array(end(-1, head), end(LAST, tail))).alias("e"))
    return (ends.select("repo", F.lit(part).alias("part"), "e.ord", "e.text")
            .unionByName(rows.select("repo", F.lit(part).alias("part"), F.col(order).cast("bigint").alias("ord"),
                                     line.alias("text"))))


def _pct_text(part: Column, total: Column) -> Column:
    return fmt1(safe_percentage(part, total))


def header_section(overview: DataFrame, analysis_date: str) -> DataFrame:
    return overview.select("repo", fill(
        T.HEADER, name=F.col("name"), description=F.col("description"), url=F.col("url"),
        analysis_date=F.lit(analysis_date), language=F.col("language")).alias("text"))


def overview_section(overview: DataFrame, project_type: DataFrame, bytes_share: DataFrame) -> DataFrame:
    langs = block(bytes_share, ["rank"], fill(T.OVERVIEW_LANGUAGE_LINE, language=F.col("language"),
                                              pct=fmt1(F.col("pct"))), "langs")
    j = overview.join(project_type, "repo", "left").join(langs, "repo", "left")
    pt = F.coalesce(F.col("project_type"), F.lit("Unknown"))
    text = F.concat(
        fill(T.OVERVIEW, stars=thousands(F.col("stars")), forks=thousands(F.col("forks")),
             size=thousands(F.col("size_kb")), created=F.col("created"), updated=F.col("updated"),
             project_type=pt, project_type_lower=F.lower(pt)),
        _when_nonempty(F.col("langs"), T.OVERVIEW_LANGUAGES_HEAD, "\n"),
        F.when(F.col("topics") != "", fill(T.OVERVIEW_TOPICS, topics=F.col("topics"))).otherwise(F.lit("")),
        F.when(F.coalesce(F.col("license"), F.lit("")) != "", fill(T.OVERVIEW_LICENSE, license=F.col("license")))
         .otherwise(F.lit("")))
    return j.select("repo", text.alias("text"))


def structure_section(totals: DataFrame, lang_dist: DataFrame, lang_first: DataFrame, dirs: DataFrame,
                      cats: DataFrame, largest: DataFrame) -> DataFrame:
    ld = lang_dist.join(lang_first, ["repo", "language"])
    bar = F.concat(F.lit("`"), F.repeat(F.lit(T.PROGRESS_FULL), F.col("bar_len")),
                   F.repeat(F.lit(T.PROGRESS_EMPTY), F.lit(rules.PROGRESS_WIDTH) - F.col("bar_len")), F.lit("`"))
    lang_lines = block(ld.withColumn("neg", -F.col("files")), ["neg", "first_seq"],
                       fill(T.STRUCTURE_LANGUAGE_LINE, language=F.col("language"), files=F.col("files"),
                            pct=fmt1(F.col("pct")), bar=bar), "lang_lines")
    dname = F.when(F.col("directory") == "root", F.lit(T.ROOT_DIRECTORY_LABEL)).otherwise(F.col("directory"))
    dir_lines = block(dirs, ["rank"], fill(T.DIRECTORY_ROW, directory=dname, files=F.col("files")), "dir_lines")
    cat_idx = F.create_map(*[x for i, c in enumerate(rules.CATEGORIES) for x in (F.lit(c), F.lit(i))])
    cat_label = F.create_map(*[x for c, lb in T.CATEGORY_LABELS.items() for x in (F.lit(c), F.lit(lb))])
    cat_lines = block(cats.withColumn("ci", F.element_at(cat_idx, F.col("category"))), ["ci"],
                      fill(T.CATEGORY_LINE, label=F.element_at(cat_label, F.col("category")), files=F.col("files")),
                      "cat_lines")
    big_lines = block(largest.where(F.col("rank") <= rules.LARGEST_SHOWN), ["rank"],
                      fill(T.LARGEST_ROW, path=F.col("path"), size=format_size(F.col("size"))), "big_lines")
    j = (totals.join(lang_lines, "repo", "left").join(dir_lines, "repo", "left")
               .join(cat_lines, "repo", "left").join(big_lines, "repo", "left")
               .fillna("", ["lang_lines", "dir_lines", "cat_lines", "big_lines"]))
    text = F.concat(
        fill(T.STRUCTURE, total_files=thousands(F.col("total_files")), total_size=format_size(F.col("total_size"))),
        F.col("lang_lines"), F.lit(T.STRUCTURE_DIRECTORIES),
        _when_nonempty(F.col("dir_lines"), T.DIRECTORY_TABLE_HEAD),
        F.lit(T.STRUCTURE_CATEGORIES), F.col("cat_lines"),
        _when_nonempty(F.col("big_lines"), T.LARGEST_HEAD))
    return j.select("repo", text.alias("text"))


def tech_stack_section(stack: DataFrame) -> DataFrame:
    """From technology_stack rows; the package-manager list (one entry per
    manifest file) stays one fragment per line."""
    bounded = stack.where(F.col("section") != "package_managers")
    sections = bounded.groupBy("repo", "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))),
                                 lambda x: F.concat(F.lit("- "), x["item"], F.lit("\n"))), "").alias("lines"))
    wide = sections.groupBy("repo").pivot("section", ["project_type", *T.TECH_CATEGORY_ORDER,
                                                      "frameworks", "build_tools", "testing_frameworks"]) \
                   .agg(F.first("lines"))
    pt = F.regexp_replace(F.coalesce(F.col("project_type"), F.lit("- Unknown\n")), r"^- |\n$", "")
    cats = [_when_nonempty(F.col(c), f"### {T.TECH_CATEGORY_LABELS[c]}\n\n", "\n") for c in T.TECH_CATEGORY_ORDER]
    tools = F.concat(*[_when_nonempty(F.col(k), head, "\n") for k, head in T.TOOL_GROUP_LABELS])
    managers = stack.where(F.col("section") == "package_managers").withColumnRenamed("pos", "file_seq")
    return (one_fragment(wide, F.concat(fill(T.TECH_STACK, project_type=pt), *cats), 0)
            .unionByName(list_fragments(managers, 1, T.PACKAGE_MANAGERS_HEAD,
                                        F.concat(F.lit("- "), F.col("item"), F.lit("\n"))))
            .unionByName(one_fragment(wide, _when_nonempty(tools, T.DEV_TOOLS_HEAD), 2)))


def dependencies_section(deps: DataFrame, top: DataFrame, base: DataFrame) -> DataFrame:
    """``base``: one row per repository (the section is rendered for all)."""
    total = base.select("repo").join(deps.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("scope") == "dev").alias("n_dev")), "repo", "left") \
        .fillna(0, ["total", "n_dev"])
    first = deps.groupBy("repo", "scope", "manager").agg(F.min(F.struct("file_seq", "pos")).alias("first"))
    lines = block(top.join(first, ["repo", "scope", "manager"]), ["rank"],
                  fill(T.DEPENDENCY_LINE, package=F.col("package")), "pkg_lines", keys=("repo", "scope", "manager"))
    per_mgr = (lines.join(top.select("repo", "scope", "manager", "total", "more").distinct(), ["repo", "scope", "manager"])
                    .join(first, ["repo", "scope", "manager"]))
    mgr_text = F.concat(fill(T.MANAGER_LINE, manager=F.initcap(F.col("manager")), n=F.col("total")), F.col("pkg_lines"),
                        F.when(F.col("more") > 0, fill(T.MORE_LINE, n=F.col("more"))).otherwise(F.lit("")), F.lit("\n"))
    prod = block(per_mgr.where(F.col("scope") == "prod"), ["first"], mgr_text, "prod")
    dev = block(per_mgr.where(F.col("scope") == "dev"), ["first"], mgr_text, "dev")
    j = total.join(prod, "repo", "left").join(dev, "repo", "left").fillna("", ["prod", "dev"])
    text = F.concat(fill(T.DEPENDENCIES, total=F.col("total")),
                    F.when(F.col("total") > 0, F.concat(F.lit(T.PROD_HEAD), F.col("prod"))).otherwise(F.lit("")),
                    F.when(F.col("n_dev") > 0, F.concat(F.lit(T.DEV_HEAD), F.col("dev"))).otherwise(F.lit("")))
    return j.select("repo", text.alias("text"))


def metrics_section(totals: DataFrame, by_lang: DataFrame, lang_first: DataFrame, fm: DataFrame,
                    base: DataFrame) -> DataFrame:
    """``totals``: ``fm_stats`` rows; ``base``: one row per repository (the
    section is rendered for all)."""
    totals = base.select("repo").join(totals, "repo", "left").fillna(
        0, ["total_lines", "code_lines", "comment_lines", "blank_lines", "files_analyzed", "n_big", "n_deep"]).fillna(
        0.0, ["code_pct", "comment_pct", "blank_pct"])
    rows = block(by_lang.join(lang_first, ["repo", "language"]).withColumn("neg", -F.col("lines")),
                 ["neg", "first_seq"],
                 fill(T.METRICS_ROW, language=F.col("language"), files=F.col("files"), lines=thousands(F.col("lines")),
                      code=thousands(F.col("code_lines")), comments=thousands(F.col("comment_lines"))), "rows")
    big = fm.where(F.col("lines") > rules.LARGE_FILE_LINES)
    deep = fm.where(F.col("max_indentation") > rules.DEEP_NESTING_LEVEL)
    j = totals.join(rows, "repo", "left").fillna("", ["rows"]).fillna(0, ["n_big", "n_deep"])
    text = F.concat(
        fill(T.METRICS, total_lines=thousands(F.col("total_lines")), code_lines=thousands(F.col("code_lines")),
             code_pct=fmt1(F.col("code_pct")), comment_lines=thousands(F.col("comment_lines")),
             comment_pct=fmt1(F.col("comment_pct")), blank_lines=thousands(F.col("blank_lines")),
             blank_pct=fmt1(F.col("blank_pct")), files_analyzed=thousands(F.col("files_analyzed"))),
        _when_nonempty(F.col("rows"), T.METRICS_TABLE_HEAD),
        F.when((F.col("n_big") + F.col("n_deep")) > 0, F.lit(T.COMPLEXITY_HEAD)).otherwise(F.lit("")))
    heads = j.select("repo", "n_big", "n_deep")
    return (one_fragment(j, text, 0)
            .unionByName(one_fragment(heads.where("n_big > 0"), fill(T.LARGE_FILES_HEAD, n=F.col("n_big")), 1))
            .unionByName(list_fragments(big, 2, "", fill(T.LARGE_FILE_LINE, path=F.col("path"), lines=F.col("lines"))))
            .unionByName(one_fragment(heads.where("n_deep > 0"), fill(T.NESTED_HEAD, n=F.col("n_deep")), 3))
            .unionByName(list_fragments(deep, 4, "", fill(T.NESTED_LINE, path=F.col("path"),
                                                          depth=F.col("max_indentation")))))


def architecture_section(flags: DataFrame) -> DataFrame:
    from codecensus.operators.patterns import api_type_expr, architecture_expr
    arch = architecture_expr()
    api = api_type_expr()
    arch_lines = F.array_join(F.transform(arch, lambda p: fill(T.ARCH_LINE, pattern=p)), "")
    text = F.concat(
        F.lit(T.ARCHITECTURE),
        F.when(F.size(arch) > 0, F.concat(F.lit(T.ARCH_HEAD), arch_lines, F.lit("\n"))).otherwise(F.lit("")),
        F.when(api.isNotNull(), fill(T.API_BLOCK, api_type=api)).otherwise(F.lit("")),
        F.when((F.size(arch) == 0) & api.isNull(), F.lit(T.ARCH_NONE)).otherwise(F.lit("")))
    return flags.select("repo", text.alias("text"))


def code_analysis_section(explanations: DataFrame, insights: DataFrame, order: DataFrame) -> DataFrame:
    """Only for repositories with explanations: one fragment per file, in the
    order of importance and then of the explanations."""
    def items_text(col: str, tmpl: str) -> Column:
        a, b = tmpl.split("{x}")
        return F.array_join(F.transform(F.col(col), lambda x: F.concat(F.lit(a), x["value"], F.lit(b))), "")

    per_file = F.concat(
        fill(T.CA_FILE, path=F.col("path"), language=F.col("language"), complexity=F.col("complexity_assessment"),
             summary=F.col("summary")),
        F.when(F.coalesce(F.col("main_functionality"), F.lit("")) != "",
               fill(T.CA_FUNCTIONALITY, functionality=F.col("main_functionality"))).otherwise(F.lit("")),
        *[F.when(F.size(c) > 0, F.concat(F.lit(head), items_text(c, tmpl), F.lit("\n"))).otherwise(F.lit(""))
          for c, head, tmpl in T.CA_LIST_HEADS],
        F.lit(T.CA_FILE_END))
    ordered = explanations.join(order, ["repo", "path"]).withColumn(
        "place", F.shiftleft(F.col("importance").cast("bigint"), 40) + F.col("order_key"))
    overview = code_analysis_overview(insights, T.CA_PATTERNS_SHOWN, T.CA_TECH_SHOWN)

    def listed(section: str, part: int, head: str, line: Column) -> DataFrame:
        return list_fragments(overview.where(F.col("section") == section), part, head, line, order="pos")

    bullet = F.concat(F.lit("- "), F.col("value"), F.lit("\n"))
    total = overview.where(F.col("section") == "files")
    return (one_fragment(total, F.concat(F.lit(T.CODE_ANALYSIS), fill(T.CA_OVERVIEW, n=F.col("n"))), 0)
            .unionByName(listed("complexity", 1, T.CA_COMPLEXITY_HEAD,
                                fill(T.CA_COMPLEXITY_LINE, complexity=F.col("value"), files=F.col("n"))))
            .unionByName(listed("pattern", 2, T.CA_PATTERNS_HEAD, bullet))
            .unionByName(listed("technology", 3, T.CA_TECH_HEAD, bullet))
            .unionByName(list_fragments(ordered, 4, T.CA_DETAILS_HEAD, per_file, tail="", order="place"))
            .unionByName(listed("theme", 5, T.CA_THEMES, fill(T.CA_THEME_LINE, theme=F.col("value")))))


def documentation_section(files: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    q = documentation_quality(files, stats)
    g = documentation_groups(files)
    named = g.where(F.col("doc_group") != "Other")
    other = g.where(F.col("doc_group") == "Other")
    tier_line = F.element_at(F.create_map(*[x for t, line in T.DOC_TIER_LINES.items() for x in (F.lit(t), F.lit(line))]),
                             F.col("tier"))
    head = F.concat(fill(T.DOCUMENTATION, n=F.col("documentation_files"), pct=fmt1(F.col("ratio"))),
                    F.when(F.col("documentation_files") > 0, F.lit(T.DOC_AVAILABLE)).otherwise(F.lit("")))
    out = one_fragment(q, head, 0)
    for i, (grp, _) in enumerate(rules.DOC_GROUPS):
        out = out.unionByName(list_fragments(
            named.where(F.col("doc_group") == grp), 1 + i,
            T.DOC_GROUP_HEAD.replace("{label}", T.DOC_GROUP_LABELS[grp]),
            fill(T.DOC_FILE_LINE, path=F.col("path"))))
    n = len(rules.DOC_GROUPS)
    return (out.unionByName(list_fragments(other, 1 + n, T.DOC_OTHER_HEAD, fill(T.DOC_FILE_LINE, path=F.col("path"))))
               .unionByName(one_fragment(q, F.concat(F.lit(T.DOC_QUALITY), tier_line), 2 + n)))


def workflow_section(files: DataFrame, repos: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    ci_rows, build_rows = workflow_files(files, "ci"), workflow_files(files, "build")
    wf = workflow_summary(files, repos, stats)

    def flag(c: str) -> Column:
        return F.when(F.col(c), F.lit(T.ENABLED)).otherwise(F.lit(T.DISABLED))

    testing = fill(T.TESTING, n=F.col("test_files"), pct=fmt1(F.col("test_pct")))
    features = fill(T.FEATURES, issues=flag("has_issues"), projects=flag("has_projects"), wiki=flag("has_wiki"))
    line = fill(T.DOC_FILE_LINE, path=F.col("path"))
    return (one_fragment(wf, F.lit(T.WORKFLOW), 0)
            .unionByName(list_fragments(ci_rows, 1, T.CI_HEAD, line))
            .unionByName(one_fragment(wf.where("test_files > 0"), testing, 2))
            .unionByName(list_fragments(build_rows, 3, T.BUILD_HEAD, line))
            .unionByName(one_fragment(wf, features, 4)))


def recommendations_section(recs: DataFrame) -> DataFrame:
    lines = block(recs, ["pos"], fill(T.RECOMMENDATION_LINE, i=F.col("pos"), text=F.col("text")), "lines")
    great = F.lit(rules.RECOMMENDATIONS["none"])
    body = F.regexp_replace(F.col("lines"), r"^1\. " + re.escape(rules.RECOMMENDATIONS["none"]), "")
    text = F.concat(F.lit(T.RECOMMENDATIONS),
                    F.when(body == "\n\n", F.concat(great, F.lit("\n\n"))).otherwise(F.col("lines")),
                    F.lit(T.BEST_PRACTICES))
    return lines.select("repo", text.alias("text"))


def footer_section(repos: DataFrame, generated_on: str) -> DataFrame:
    return repos.select("repo", fill(T.FOOTER, generated_on=F.lit(generated_on)).alias("text"))


def report_fragments(sections: list[DataFrame]) -> DataFrame:
    """(repo, section, part, ord, text): the documents as ordered, line-aligned
    fragments (each ends with a newline, except the document's last). A
    section is a (repo, text) frame or a fragment frame; a blank line
    separates consecutive sections; empty fragments are dropped."""
    rows = None
    last = len(sections) - 1
    for i, s in enumerate(sections):
        sep = T.SECTION_SEPARATOR if i < last else ""
        if "part" not in s.columns:
            frag = one_fragment(s, F.concat(F.col("text"), F.lit(sep)), 0)
        else:
            frag = s
            if sep:  # follows the row that opens the section
                row = F.struct("part", "ord", "text")
                after = F.when((F.col("part") == 0) & (F.col("ord") <= 0), F.struct(
                    F.lit(1 << 30).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.lit(sep).alias("text")))
                frag = frag.select("repo", F.explode(F.array_compact(F.array(row, after))).alias("f")).select(
                    "repo", "f.part", "f.ord", "f.text")
        frag = frag.where(F.col("text") != "").select("repo", F.lit(i).alias("section"), "part", "ord", "text")
        rows = frag if rows is None else rows.unionByName(frag)
    return rows


def render_report(sections: list[DataFrame]) -> DataFrame:
    """The documents as ordered fragments (see ``report_fragments``);
    ``sinks.write_reports`` writes them. No document is held as one value."""
    return report_fragments(sections)
