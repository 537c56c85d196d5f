"""§2.11 Analysis modes: compositions of the operators.

``analyze_quick`` never reads text. The full analysis has two steps: one pass
turns each relevant file into a narrow feature row (``plans.features``), and
``report_from_features`` derives every section from those rows. A caller that
runs the report more than once, or on large texts, writes the features as a
table in between (``session.write_table``); no builder here runs a job.
``analyze_clone`` is the collected-files flow with its three documents and
issue candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.operators import classify as C
from codecensus.operators import dependencies as D
from codecensus.operators import explanations as X
from codecensus.operators import metrics as M
from codecensus.operators import patterns as PT
from codecensus.operators import ranking as K
from codecensus.operators import reports as RP
from codecensus.operators import structure as S
from codecensus.plans import features as FT
from codecensus.sources import readers as R


def analyze_quick(files: DataFrame, repos: DataFrame) -> DataFrame:
    """filter -> structure -> quick summary; only listing columns are read."""
    rel = C.filter_files(files.select("repo", "file_seq", "path", "type", "size"))
    return RP.quick_summary(repos, rel)


def _lang_first(files: DataFrame) -> DataFrame:
    return S.language_counts(files).select("repo", "language", "first_seq")


def relevant_features(listing_text: DataFrame, max_files: int | None = None) -> DataFrame:
    """Feature rows of the relevant files; with ``max_files`` only each
    repository's first ones by priority."""
    feats = FT.file_features(C.filter_files(listing_text))
    return feats if max_files is None else C.limit_files(feats, max_files).drop("priority", "rank")


def analyze_full(listing_text: DataFrame, repos: DataFrame, responses: DataFrame | None = None,
                 focus: DataFrame | None = None, analysis_date: str = "1970-01-01 00:00:00",
                 max_files: int | None = None) -> DataFrame:
    """The full report's fragments (repo, section, part, ord, text) from
    listing columns plus ``content`` (NULL when the text was not fetched)."""
    feats = relevant_features(listing_text, max_files)
    expl = None if responses is None else selected_explanations(feats, responses, focus)
    return report_from_features(feats, repos, expl, analysis_date)


def selected_explanations(feats: DataFrame, responses: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """Explanations of the selected files. Their ``file_seq`` is the rank of
    the selection, which every "first seen" order of the report follows."""
    keys = K.key_files_from(feats).select("repo", "path")
    focus_all = keys if focus is None else keys.unionByName(focus.select("repo", "path"))
    selected = K.select_from_features(feats, focus_all).select(
        "repo", "path", F.col("rank").cast("bigint").alias("file_seq"))
    return X.parse_responses(responses.drop("file_seq").join(selected, ["repo", "path"]))


def report_from_features(feats: DataFrame, repos: DataFrame, expl: DataFrame | None = None,
                         analysis_date: str = "1970-01-01 00:00:00") -> DataFrame:
    """All sections of the full report from per-file features and, if given,
    the explanations of the selected files."""
    files = feats.select("repo", "file_seq", "path", "name", "type", "size")

    overview = R.repo_overview(repos)
    base = repos.select("repo")
    flags = PT.pattern_flags_from_hits(feats)
    pt = PT.detect_project_type(flags)
    fm = FT.metrics_from(feats)
    deps = D.dependencies_from(feats)
    managers = D.package_managers_from(feats)
    tooling = D.identify_tooling(deps)
    stats = RP.repo_file_stats(files)
    fstats = RP.fm_stats(fm)

    sections = [
        RP.header_section(overview, analysis_date),
        RP.overview_section(overview, pt, R.language_bytes_share(repos)),
        RP.structure_section(stats.select("repo", "total_files", "total_size"), S.language_distribution(files),
                             _lang_first(files), S.directory_distribution(files), RP.category_counts_from(stats),
                             S.largest_files(files)),
        RP.tech_stack_section(RP.technology_stack(flags, managers, tooling)),
        RP.dependencies_section(deps, D.top_dependencies(deps), base),
        RP.metrics_section(fstats, M.code_metrics_by_language(fm), _lang_first(files), fm, base),
        RP.architecture_section(flags),
    ]
    items = None
    if expl is not None:
        items = X.explanation_items(expl)
        sections.append(RP.code_analysis_section(expl, X.insights_summary(expl, items), K.report_file_order(expl)))
    arch_n = flags.select("repo", F.size(PT.architecture_expr()).alias("n_arch"))
    sections += [
        RP.documentation_section(files, stats),
        RP.workflow_section(files, repos, stats),
        RP.recommendations_section(RP.recommendations(
            RP.recommendation_inputs(files, fm, arch_n, items, stats, fstats))),
        RP.footer_section(repos.select("repo"), analysis_date.replace(" ", " at ", 1)),
    ]
    return RP.report_fragments(sections)


def technical_document(lines: DataFrame, insights: DataFrame) -> DataFrame:
    """The clone flow's technical document as rows (repo, section, pos,
    value, n): its structure, languages, largest files, managers and line
    metrics by the basic rules, and the insights. ``lines``: the collected
    files' ``basic_line_metrics``."""

    def rows(df: DataFrame, section: str, pos, value, n) -> DataFrame:
        return df.select("repo", F.lit(section).alias("section"), pos.cast("bigint").alias("pos"),
                         value.cast("string").alias("value"), n.cast("bigint").alias("n"))

    totals = S.structure_basic(lines)
    counts = [("total_files", "files"), ("total_size", "characters")] + [
        (f"{c}_files", c) for c in rules.CATEGORIES]
    listed = totals.select("repo", F.posexplode(F.array(*[
        F.struct(F.lit(label).alias("value"), F.col(c).cast("bigint").alias("n")) for c, label in counts])).alias("pos", "x"))
    metrics = M.code_metrics_by_language(lines)
    return (rows(listed, "structure", F.col("pos"), F.col("x.value"), F.col("x.n"))
            .unionByName(rows(S.languages_basic(lines), "language", F.lit(0), F.col("language"), F.col("files")))
            .unionByName(rows(S.largest_basic(lines), "largest", F.col("rank"), F.col("path"), F.col("size")))
            .unionByName(rows(D.package_managers_basic(lines), "manager", F.col("pos"), F.col("manager"), F.lit(1)))
            .unionByName(rows(metrics, "lines", F.lit(0), F.col("language"), F.col("lines")))
            .unionByName(insights.select("repo", F.concat(F.lit("insight:"), F.col("section")).alias("section"),
                                         "pos", "value", "n")))


def analyze_clone(contents: DataFrame, responses: DataFrame, repos: DataFrame | None = None, open_issues: DataFrame | None = None,
                  keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """Collected-files flow, with the 20-extension vocabulary and the basic
    category rules throughout: insights over every collected code file's
    reply, the functional, the technical and the build & run document, and
    the issue candidates. Returns DataFrames keyed by output name.

    Texts and replies are read once each: what the outputs need of them is a
    row per file, which ``keep`` may write as a table."""
    collected = keep(M.basic_line_metrics(R.collect_code_files(contents)), "collected")
    expl = keep(X.without_texts(X.parse_responses(
        responses.join(collected.select("repo", "path"), ["repo", "path"], "left_semi"))), "explained")
    items = X.explanation_items(expl)
    themes = X.improvement_themes(items)
    insights = X.insights_summary(expl, items)
    base_repos = repos if repos is not None else collected.select("repo").distinct()
    listing = collected.select("repo", "file_seq", "path", F.lit("file").alias("type"), "size")
    return {
        "insights": insights,
        "functional": RP.quick_summary(base_repos, listing, basic=True),
        "technical": technical_document(collected, insights),
        "build_and_run": RP.build_run_guide(collected),
        "issues": X.issue_candidates(themes, items, open_issues),
    }
