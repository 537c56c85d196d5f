"""§2.8 Explanations: prompts, replies, items and insights.

Model calls happen outside the engine; replies arrive as a table. Parsing is
per row (VARIANT). Everything downstream works on the long item table
(repo, path, file_seq, field, pos, value, is_string) with partial
aggregations; "first seen" order is ``(file_seq, pos)``, taken with
``min(struct(...))`` so hot items collapse map-side. Only top-N lists (N is
an argument, at most 10 by default) are gathered into one row, as arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions.text import cut_with_ellipsis, lines_of, strip_py
from codecensus.functions import json_text as J
from codecensus.functions import sql as S

ITEM = "struct<value:string,is_string:boolean>"
TEXT_FIELDS = ["summary", "main_functionality", "complexity_assessment"]
REPLY = ", ".join(f"{f} variant" for f in [*TEXT_FIELDS, *rules.LIST_FIELDS]) + f", {J.BAD} string"
#: for replies whose objects repeat a key, which VARIANT refuses
REPLY_TEXTS = ", ".join([f"{f} string" for f in TEXT_FIELDS] + [f"{f} array<string>" for f in rules.LIST_FIELDS])
JSON_BLOCK = r"(?s)(\{.*\})"


def code_language(path: str = "path") -> Column:
    return S.expr(f"coalesce({S.map_lookup(rules.CODE_EXTENSIONS, S.suffix(path))}, 'Unknown')")


# ---------------------------------------------------------------- prompts
def build_prompts(selected: DataFrame, template: str = rules.PROMPT_TEMPLATE) -> DataFrame:
    """(repo, path, file_seq, language, prompt) for files with text. The
    template names {language}, {file_path}, {language_lower} and {content},
    in this order."""
    a, rest = template.split("{language}", 1)
    b, rest = rest.split("{file_path}", 1)
    c, rest = rest.split("{language_lower}", 1)
    d, e = rest.split("{content}", 1)
    lang = code_language("path")
    prompt = F.concat(F.lit(a), lang, F.lit(b), F.col("path"), F.lit(c), F.lower(lang), F.lit(d),
                      F.col("content"), F.lit(e))
    return selected.select("repo", "path", "file_seq", lang.alias("language"), prompt.alias("prompt"),
                           F.length("content").alias("content_length"))


def prompt_stats(prompts: DataFrame) -> DataFrame:
    """Per prompt: content length, prompt length and lines."""
    return prompts.select(
        "repo", "path", "file_seq", "content_length",
        F.length("prompt").alias("prompt_length"),
        F.size(lines_of(F.col("prompt"))).alias("prompt_lines"))


def prompt_averages(prompts: DataFrame) -> DataFrame:
    """(repo, prompts, avg_prompt_length)."""
    return prompts.groupBy("repo").agg(F.count(F.lit(1)).alias("prompts"),
                                       F.avg(F.length("prompt")).alias("avg_prompt_length"))


# ---------------------------------------------------------------- replies
def _items(field: Column) -> Column:
    """Items of a VARIANT list with their kind."""
    return F.transform(F.try_variant_get(field, "$", "array<variant>"), lambda x: F.struct(
        F.when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string")).otherwise(F.to_json(x)).alias("value"),
        (F.schema_of_variant(x) == "STRING").alias("is_string")))


def _items_of_text(values: Column, text: Column) -> Column:
    """Items of a list read as texts; their kinds come from the list's own text."""
    kinds = J.element_kinds(text)
    return F.transform(values, lambda x, i: F.struct(x.alias("value"), (F.get(kinds, i) == "s").alias("is_string")))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Replies -> explanation rows.

    The JSON block runs from the first '{' to the last '}' and must be one
    strict JSON value: malformed text, single quotes or text after the value
    make the reply a fallback; of a repeated key the last value counts.
    Missing fields take defaults. A fallback has its first non-empty line not
    starting with '{' as summary and the whole reply as functionality;
    ``summary_short`` and ``functionality_short`` are the forms for display.
    A failed call (``error`` set) gives the fixed placeholder row. Each step
    is a projection of its own, so the block is found and parsed once per
    reply.
    """
    failed = F.col("error").isNotNull() if "error" in responses.columns else F.lit(False)
    base = responses.select("repo", "path", "file_seq", code_language("path").alias("language"),
                            failed.alias("_failed"), F.coalesce(F.col("response"), F.lit("")).alias("_resp"))
    block = base.withColumn("_block", F.when(~F.col("_failed"), F.nullif(F.regexp_extract("_resp", JSON_BLOCK, 1), F.lit(""))))
    parsed = block.withColumn("_json", F.from_json("_block", REPLY, J.STRICT))
    whole = F.col("_json").isNotNull() & F.col(f"_json.{J.BAD}").isNull()
    texts = parsed.withColumn("_whole", F.coalesce(whole, F.lit(False))).withColumns({
        "_map": F.when(~F.col("_whole"), F.from_json("_block", "map<string,string>", J.OPTIONS)),
        "_texts": F.when(~F.col("_whole"), F.from_json("_block", REPLY_TEXTS, J.OPTIONS))})
    read = F.when(F.col("_whole") | F.col("_map").isNotNull(), J.one_value(F.col("_block")))
    status = F.when(F.col("_failed"), "failed").when(F.coalesce(read, F.lit(False)), "parsed").otherwise("fallback")
    first_line = F.try_element_at(
        F.filter(lines_of(F.col("_resp")), lambda l: (strip_py(l) != "") & ~l.startswith("{")), F.lit(1))
    staged = texts.withColumn("status", status).withColumn(
        "_line", F.when(F.col("status") == "fallback", F.coalesce(strip_py(first_line), F.lit(rules.FALLBACK_SUMMARY))))

    def field(name: str) -> Column:
        value = F.when(F.col("_whole"), F.try_variant_get(f"_json.{name}", "$", "string")).otherwise(F.col(f"_texts.{name}"))
        return F.coalesce(value, F.lit(rules.EXPLANATION_DEFAULTS[name]))

    def items(name: str) -> Column:
        last = F.try_element_at(F.filter(F.map_entries("_map"), lambda e: e["key"] == name), F.lit(-1))["value"]
        twice = _items_of_text(F.col(f"_texts.{name}"), last)
        return F.coalesce(F.when(F.col("_whole"), _items(F.col(f"_json.{name}"))).otherwise(twice), none)

    fail = rules.FAILED_EXPLANATION
    none = F.array().cast(f"array<{ITEM}>")

    def pick(parsed_value: Column, fallback: Column, failed_value: Column) -> Column:
        return (F.when(F.col("status") == "failed", failed_value).when(F.col("status") == "parsed", parsed_value)
                .otherwise(fallback))

    out = staged.select(
        "repo", "path", "file_seq", "language", "status",
        pick(field("summary"), F.col("_line"), F.lit(fail["summary"])).alias("summary"),
        pick(field("main_functionality"), F.col("_resp"), F.lit(fail["main_functionality"])).alias("main_functionality"),
        pick(field("complexity_assessment"), F.lit("Unknown"),
             F.lit(fail["complexity_assessment"])).alias("complexity_assessment"),
        *[pick(items(f), none, none).alias(f) for f in rules.LIST_FIELDS])
    fallback = F.col("status") == "fallback"
    return out.select(
        "*", F.when(fallback, cut_with_ellipsis(F.col("summary"), rules.FALLBACK_SUMMARY_CUT))
        .otherwise(F.col("summary")).alias("summary_short"),
        F.when(fallback, cut_with_ellipsis(F.col("main_functionality"), rules.FALLBACK_FUNCTIONALITY_CUT))
        .otherwise(F.col("main_functionality")).alias("functionality_short"))


def without_texts(explanations: DataFrame) -> DataFrame:
    """Explanations without the summary and functionality texts: all that the
    insights, usages and issue candidates read."""
    return explanations.drop("summary", "main_functionality", "summary_short", "functionality_short")


def object_text(value: Column) -> Column:
    """'text', else 'description' of an object's JSON text (of a repeated key
    the last); empty ones do not count."""
    fields = F.from_json(value, "text string, description string", J.OPTIONS)
    return F.coalesce(F.nullif(fields["text"], F.lit("")), F.nullif(fields["description"], F.lit("")))


def explanation_items(explanations: DataFrame) -> DataFrame:
    """(repo, path, file_seq, language, field, pos, value, is_string)."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("items")) for f in rules.LIST_FIELDS])
    return (explanations.select("repo", "path", "file_seq", "language", F.explode(fields).alias("f"))
                        .select("repo", "path", "file_seq", "language", F.col("f.field").alias("field"),
                                F.posexplode("f.items").alias("pos", "it"))
                        .select("repo", "path", "file_seq", "language", "field", F.col("pos").cast("int"),
                                F.col("it.value").alias("value"), F.col("it.is_string").alias("is_string")))


def _first_word(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


# ---------------------------------------------------------------- insights
def complexity_distribution(explanations: DataFrame) -> DataFrame:
    """(repo, complexity, files): first word of the assessment (split on one
    space, so 'Moderate.' keeps its dot). Files without one are left out while
    counting: Spark would put a filter below the parsing of the replies and
    repeat the whole parse in it."""
    ca = F.col("complexity_assessment")
    given = ca.isNotNull() & (ca != "")
    return (explanations.groupBy("repo", _first_word(ca).alias("complexity"))
                        .agg(F.count_if(given).alias("files"), F.min(F.when(given, F.col("file_seq"))).alias("first_seq"))
                        .where(F.col("files") > 0))


def _ranked_counts(items: DataFrame, field: str, n: int | None, label: str) -> DataFrame:
    """(repo, rank, <label>, occurrences) of string items of one field,
    by count then first appearance."""
    agg = (items.where((F.col("field") == field) & F.col("is_string"))
                .groupBy("repo", F.col("value").alias(label))
                .agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("file_seq", "pos")).alias("first")))
    w = Window.partitionBy("repo").orderBy(F.col("occurrences").desc(), F.col("first"))
    ranked = agg.withColumn("rank", F.row_number().over(w))
    if n is not None:
        ranked = ranked.where(F.col("rank") <= n)
    return ranked.select("repo", "rank", label, "occurrences")


def common_patterns(items: DataFrame, n: int = rules.COMMON_PATTERNS_N) -> DataFrame:
    return _ranked_counts(items, "code_patterns", n, "pattern")


def key_technologies(items: DataFrame, n: int = rules.KEY_TECHNOLOGIES_N) -> DataFrame:
    return _ranked_counts(items, "dependencies", n, "technology")


def _theme_hits(text: str = "value") -> Column:
    lt = f"lower({text})"
    return S.expr("array_compact(array(" + ", ".join(
        f"CASE WHEN {S.contains_any(lt, words)} THEN named_struct('idx', {i}, 'theme', {S.q(theme)}) END"
        for i, (theme, words) in enumerate(rules.IMPROVEMENT_THEMES)) + "))")


def improvement_themes(items: DataFrame) -> DataFrame:
    """(repo, rank, theme, suggestions): multi-label themes of string
    suggestions, ranked by first appearance."""
    hits = (items.where((F.col("field") == "improvement_suggestions") & F.col("is_string"))
                 .select("repo", "file_seq", "pos", F.explode(_theme_hits("value")).alias("h")))
    agg = hits.groupBy("repo", F.col("h.theme").alias("theme")).agg(
        F.count(F.lit(1)).alias("suggestions"), F.min(F.struct("file_seq", "pos", F.col("h.idx").alias("idx"))).alias("first"))
    w = Window.partitionBy("repo").orderBy("first")
    return agg.select("repo", F.row_number().over(w).alias("rank"), "theme", "suggestions")


def _listed(df: DataFrame, value: str, alias: str) -> DataFrame:
    """Top-N rows -> one array per repo, in rank order."""
    return df.groupBy("repo").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(alias))


def insights_summary(explanations: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(repo, section, pos, value, n): the insights as rows, ordered by pos in
    each section: 'files' (the number analysed), 'complexity' (first words of
    the assessments in first-seen order), 'pattern' and 'technology' (top N
    with their uses) and 'theme' (with its suggestions)."""
    items = explanation_items(explanations) if items is None else items

    def rows(df: DataFrame, section: str, pos: str, value: Column, n: str) -> DataFrame:
        return df.select("repo", F.lit(section).alias("section"), F.col(pos).cast("bigint").alias("pos"),
                         value.alias("value"), F.col(n).cast("bigint").alias("n"))

    total = explanations.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).withColumn("pos", F.lit(0))
    return (rows(total, "files", "pos", F.lit(None).cast("string"), "n")
            .unionByName(rows(complexity_distribution(explanations), "complexity", "first_seq", F.col("complexity"), "files"))
            .unionByName(rows(common_patterns(items), "pattern", "rank", F.col("pattern"), "occurrences"))
            .unionByName(rows(key_technologies(items), "technology", "rank", F.col("technology"), "occurrences"))
            .unionByName(rows(improvement_themes(items), "theme", "rank", F.col("theme"), "suggestions")))


def _category() -> Column:
    return S.expr(S.case_first([(S.contains_any("lower(value)", words), S.q(name))
                                for name, words in rules.IMPROVEMENT_CATEGORIES], S.q(rules.IMPROVEMENT_OTHER)))


def improvement_categories(items: DataFrame) -> DataFrame:
    """(repo, category, suggestions): first matching of seven categories, else Other."""
    return (items.where((F.col("field") == "improvement_suggestions") & F.col("is_string"))
                 .groupBy("repo", _category().alias("category")).agg(F.count(F.lit(1)).alias("suggestions")))


def complexity_groups(explanations: DataFrame) -> DataFrame:
    """(repo, complexity, file_seq, path, language, summary, summary_short):
    files grouped by the full assessment text; the short form has 100
    characters and '...'."""
    return explanations.select("repo", F.col("complexity_assessment").alias("complexity"), "file_seq", "path",
                               "language", "summary", cut_with_ellipsis(F.col("summary"), 100).alias("summary_short"))


def size_by_complexity(explanations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(repo, complexity, avg_lines, files): line counts of the retrieved text
    (a file without text counts 1 line) per first complexity word."""
    lines = retrieved.select("repo", "path", F.size(lines_of(F.col("content"))).alias("lines"))
    ca = F.col("complexity_assessment")
    word = F.when(ca.isNotNull() & (ca != ""), _first_word(ca)).otherwise(F.lit("Unknown"))
    e = explanations.select("repo", "path", word.alias("complexity"))
    return (e.join(lines, ["repo", "path"], "left")
             .groupBy("repo", "complexity")
             .agg(F.avg(F.coalesce("lines", F.lit(1))).alias("avg_lines"), F.count(F.lit(1)).alias("files")))


def _first_files(items: DataFrame, key: str, n: int, label_expr: Column) -> DataFrame:
    """First ``n`` usages per (repo, key) as one array."""
    w = Window.partitionBy("repo", key).orderBy("file_seq", "pos")
    top = (items.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
                .select("repo", key, "r", label_expr.alias("label")))
    return top.groupBy("repo", key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("first_files"))


def dependency_usage(items: DataFrame, n: int = rules.DEPENDENCY_USAGE_N,
                     shown: int = rules.USAGE_FILES_SHOWN) -> DataFrame:
    """(repo, rank, dependency, files, first_files): the top N dependencies
    by number of uses, with the first files using each."""
    deps = items.where((F.col("field") == "dependencies") & F.col("is_string")).withColumnRenamed("value", "dependency")
    ranked = _ranked_counts(items, "dependencies", n, "dependency").withColumnRenamed("occurrences", "files")
    firsts = _first_files(deps.join(ranked.select("repo", "dependency"), ["repo", "dependency"], "left_semi"),
                          "dependency", shown, F.col("path"))
    return ranked.join(firsts, ["repo", "dependency"]).select("repo", "rank", "dependency", "files", "first_files")


def pattern_usage(items: DataFrame, n: int = rules.PATTERN_USAGE_N, shown: int = rules.USAGE_FILES_SHOWN) -> DataFrame:
    """(repo, rank, pattern, files, languages, language_list, first_files)."""
    pats = items.where((F.col("field") == "code_patterns") & F.col("is_string")).withColumnRenamed("value", "pattern")
    ranked = _ranked_counts(items, "code_patterns", n, "pattern").withColumnRenamed("occurrences", "files")
    top = pats.join(ranked.select("repo", "pattern"), ["repo", "pattern"], "left_semi")
    langs = top.groupBy("repo", "pattern").agg(
        F.count_distinct("language").alias("languages"),
        F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("language_list"))
    firsts = _first_files(top, "pattern", shown, F.concat(F.col("path"), F.lit(" ("), F.col("language"), F.lit(")")))
    return (ranked.join(langs, ["repo", "pattern"]).join(firsts, ["repo", "pattern"])
                  .select("repo", "rank", "pattern", "files", "languages", "language_list", "first_files"))


def explanation_overview(explanations: DataFrame, items: DataFrame | None = None, n: int = 5) -> DataFrame:
    """One row per repo: files, languages used, distinct patterns and
    dependencies, pattern uses per file, and the top ``n`` of each by use."""
    items = explanation_items(explanations) if items is None else items
    base = explanations.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("language").alias("n_languages"),
        F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"))
    s = items.where(F.col("is_string"))
    distinct = s.groupBy("repo").agg(
        F.count_distinct(F.when(F.col("field") == "code_patterns", F.col("value"))).alias("unique_patterns"),
        F.count_distinct(F.when(F.col("field") == "dependencies", F.col("value"))).alias("unique_dependencies"),
        F.count_if(F.col("field") == "code_patterns").alias("pattern_uses"))
    none = F.array().cast("array<string>")
    return (base.join(distinct, "repo", "left")
                .join(_listed(common_patterns(items, n), "pattern", "top_patterns"), "repo", "left")
                .join(_listed(key_technologies(items, n), "technology", "top_dependencies"), "repo", "left")
                .fillna(0, ["unique_patterns", "unique_dependencies", "pattern_uses"])
                .withColumn("patterns_per_file", F.col("pattern_uses") / F.col("files")).drop("pattern_uses")
                .withColumn("top_patterns", F.coalesce("top_patterns", none))
                .withColumn("top_dependencies", F.coalesce("top_dependencies", none)))


def explanation_details(explanations: DataFrame) -> DataFrame:
    """Per file: the structured record with its whole lists, the numbers of
    entries that a display of 5, 5, 3 and 3 leaves out, the whole
    functionality and its form for display (197 characters and '...' when
    over 200)."""
    f = F.col("main_functionality")
    shown = [("key_components", 5), ("dependencies", 5), ("code_patterns", 3), ("improvement_suggestions", 3)]
    cols = []
    for name, k in shown:
        cols += [F.transform(name, lambda x: x["value"]).alias(name),
                 F.greatest(F.size(name) - k, F.lit(0)).alias(f"{name}_more")]
    return explanations.select(
        "repo", "path", "file_seq", "language", "summary", "complexity_assessment", f.alias("functionality"),
        cut_with_ellipsis(f, 197, 200).alias("functionality_short"), *cols)


def analysis_success(explanations: DataFrame) -> DataFrame:
    """Per file: success flag and item counts."""
    return explanations.select(
        "repo", "path", "file_seq", (F.col("status") != "failed").alias("success"),
        *[F.size(f).alias(f"{f}_count") for f in rules.LIST_FIELDS], "complexity_assessment")


def success_ratio(explanations: DataFrame) -> DataFrame:
    """(repo, files, success_pct)."""
    return explanations.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        (F.count_if(F.col("status") != "failed") / F.count(F.lit(1)) * 100).alias("success_pct"))


def code_analysis_overview(insights: DataFrame, patterns: int = 5, technologies: int = 8) -> DataFrame:
    """The report's block of the insights: files analysed, complexity counts,
    the first patterns and technologies, themes; rows as in ``insights``."""
    keep = (~F.col("section").isin("pattern", "technology")
            | ((F.col("section") == "pattern") & (F.col("pos") <= patterns))
            | ((F.col("section") == "technology") & (F.col("pos") <= technologies)))
    return insights.where(keep)


def run_summary(retrieved: DataFrame, selected: DataFrame, explanations: DataFrame,
                prompts: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row of counts per repo: retrieved, selected, analysed, languages,
    distinct patterns and dependencies, average prompt length, suggestions
    in all and by category."""
    items = explanation_items(explanations) if items is None else items
    r = retrieved.groupBy("repo").agg(F.count(F.lit(1)).alias("files_retrieved"))
    s = selected.groupBy("repo").agg(F.count(F.lit(1)).alias("files_selected"))
    ov = explanation_overview(explanations, items).select(
        "repo", F.col("files").alias("files_analyzed"), F.col("n_languages").alias("languages_used"),
        "unique_patterns", "unique_dependencies")
    p = prompts.groupBy("repo").agg(F.avg(F.length("prompt")).alias("avg_prompt_length"))
    names = [c for c, _ in rules.IMPROVEMENT_CATEGORIES] + [rules.IMPROVEMENT_OTHER]
    by_category = {c: "suggestions_" + c.lower().replace(" ", "_") for c in names}
    sg = (items.where(F.col("field") == "improvement_suggestions").withColumn("_c", _category()).groupBy("repo").agg(
        F.count(F.lit(1)).alias("suggestions"),
        *[F.count_if((F.col("_c") == c) & F.col("is_string")).alias(a) for c, a in by_category.items()]))
    return (r.join(s, "repo", "left").join(ov, "repo", "left").join(p, "repo", "left").join(sg, "repo", "left")
             .fillna(0, ["files_selected", "files_analyzed", "languages_used", "unique_patterns",
                         "unique_dependencies", "suggestions", *by_category.values()]))


def issue_candidates(themes: DataFrame, items: DataFrame, open_issues: DataFrame | None = None) -> DataFrame:
    """(repo, ord_theme, ..., title, body, labels): technical-debt candidates.

    'Investigate: <theme>' for each theme, then every suggestion (objects
    give their 'text' or 'description', else their JSON). De-duplicated on
    the lower-cased whole text, first kept (a partial ``min`` aggregation
    per key, so a suggestion repeated everywhere collapses map-side).
    ``title_short`` has at most 120 characters. With ``open_issues`` those
    whose title, whole or short, is open already (case-insensitive) go.
    """
    t = themes.select("repo", F.lit(0).alias("src"), F.col("rank").cast("bigint").alias("o1"),
                      F.lit(0).alias("o2"), F.concat(F.lit(rules.ISSUE_THEME_PREFIX), F.col("theme")).alias("text"))
    sug = items.where((F.col("field") == "improvement_suggestions") & (F.col("is_string") | F.col("value").startswith("{")))
    text = F.when(F.col("is_string"), strip_py(F.col("value"))).otherwise(
        F.coalesce(object_text(F.col("value")), F.col("value")))
    s = sug.select("repo", F.lit(1).alias("src"), F.col("file_seq").alias("o1"), F.col("pos").alias("o2"),
                   text.alias("text"))
    cands = t.unionByName(s).withColumn("text", strip_py(F.col("text")))
    firsts = (cands.where(F.col("text") != "")
                   .groupBy("repo", F.lower("text").alias("k"))
                   .agg(F.min(F.struct("src", "o1", "o2", "text")).alias("c"))
                   .select("repo", "c.src", "c.o1", "c.o2", "c.text"))
    short = F.when(F.length("text") <= rules.ISSUE_TITLE_MAX, F.col("text")).otherwise(
        F.concat(F.substring("text", 1, rules.ISSUE_TITLE_CUT), F.lit("...")))
    out = firsts.withColumn("title", F.col("text")).withColumn("title_short", short)
    if open_issues is not None:
        o = open_issues.select(F.col("repo").alias("o_repo"), F.lower("title").alias("lt")).distinct()
        for c in ("title", "title_short"):
            out = out.join(o, (F.col("repo") == F.col("o_repo")) & (F.lower(c) == F.col("lt")), "left_anti")
    body = F.concat(F.lit(rules.ISSUE_BODY_HEAD), F.col("text"), F.lit(rules.ISSUE_BODY_TAIL),
                    F.col("repo"), F.lit("/" + rules.ISSUE_REPORT_NAME), F.lit("\n"))
    return out.select("repo", "src", "o1", "o2", "title", "title_short", body.alias("body"),
                      F.array(*map(F.lit, rules.ISSUE_LABELS)).alias("labels"))
