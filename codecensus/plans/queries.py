"""Registered queries: one per operator of the blueprint, each a function
``(spark, sf_dir) -> DataFrame`` over the whole corpus derived from the
driver tables. Result columns are aliased to match ``oracle.SQL``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecensus.functions.key_filter import matching
from codecensus.functions.paths import directory_of
from codecensus.operators import classify as C
from codecensus.operators import dependencies as D
from codecensus.operators import distinct_bitmaps as DB
from codecensus.operators import explanations as X
from codecensus.operators import ranking as K
from codecensus.operators import reports as RP
from codecensus.operators import metrics as M
from codecensus.operators import patterns as PT
from codecensus.operators import pieces as PC
from codecensus.operators import structure as S
from codecensus.operators import top_values as TV
from codecensus.plans import features as FT
from codecensus.plans import modes as MD
from codecensus.plans import upkeep as UP
from codecensus.session import shared_dir, write_table
from codecensus.sources import activity as A
from codecensus.sources import corpus as src
from codecensus.sources import readers as R
from codecensus.sources import search_index as SI
from codecensus.sources import sinks
from codecensus.streaming import replaced as RS

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _texts(df: DataFrame) -> DataFrame:
    """Arrays as '|'-joined text, for comparison with the oracle."""
    return df.select(*[F.array_join(c, "|").alias(c) if t == "array<string>" else c for c, t in df.dtypes])


def _relevant(spark, sf_dir) -> DataFrame:
    """The listing after the reference's relevance filter."""
    return C.filter_files(src.files(spark, sf_dir))


# ---------------------------------------------------------------- §2.2
@query
def with_path_parts(spark, sf_dir):
    f = C.with_path_parts(src.files(spark, sf_dir))
    return f.select("repo", "file_seq", "name", "suffix", "directory", "depth", "parent",
                    F.size("parts").alias("n_parts"))


@query
def filter_files(spark, sf_dir):
    return _relevant(spark, sf_dir).select("repo", "file_seq", "path", "size")


@query
def with_priority_score(spark, sf_dir):
    return C.with_priority_score(src.files(spark, sf_dir)).select("repo", "file_seq", "path", "priority")


@query
def limit_files(spark, sf_dir):
    return C.limit_files(_relevant(spark, sf_dir)).select("repo", "file_seq", "path", "priority", "rank")


@query
def detect_language(spark, sf_dir):
    return C.detect_language(src.files(spark, sf_dir)).select("repo", "file_seq", "language")


@query
def config_purpose(spark, sf_dir):
    return C.config_purpose(src.files(spark, sf_dir)).select("repo", "file_seq", "name", "purpose")


@query
def classify_files(spark, sf_dir):
    return C.classify_files(_relevant(spark, sf_dir)).select(
        "repo", "file_seq", "is_source", "is_test", "is_config", "is_documentation", "is_build")


@query
def classify_files_basic(spark, sf_dir):
    return C.classify_files_basic(src.contents(spark, sf_dir)).select(
        "repo", "file_seq", "is_source", "is_test", "is_config", "is_documentation", "is_build")


# ---------------------------------------------------------------- §2.3
@query
def structure_totals(spark, sf_dir):
    return S.structure_totals(_relevant(spark, sf_dir))


@query
def language_distribution(spark, sf_dir):
    return S.language_distribution(_relevant(spark, sf_dir))


@query
def extension_distribution(spark, sf_dir):
    return S.extension_distribution(_relevant(spark, sf_dir))


@query
def directory_listing(spark, sf_dir):
    return S.directory_listing(_relevant(spark, sf_dir))


@query
def directory_distribution(spark, sf_dir):
    return S.directory_distribution(_relevant(spark, sf_dir))


@query
def depth_histogram(spark, sf_dir):
    return S.depth_histogram(_relevant(spark, sf_dir))


@query
def largest_files(spark, sf_dir):
    return S.largest_files(_relevant(spark, sf_dir))


@query
def category_counts(spark, sf_dir):
    return S.category_counts(_relevant(spark, sf_dir))


@query
def category_files(spark, sf_dir):
    return S.category_files(_relevant(spark, sf_dir))


@query
def structure_basic(spark, sf_dir):
    return S.structure_basic(src.contents(spark, sf_dir))


@query
def languages_basic(spark, sf_dir):
    return S.languages_basic(src.contents(spark, sf_dir))


@query
def largest_basic(spark, sf_dir):
    return S.largest_basic(src.contents(spark, sf_dir))


@query
def analysis_metadata(spark, sf_dir):
    listing = src.files(spark, sf_dir)
    return S.analysis_metadata(listing, C.filter_files(listing))



# ---------------------------------------------------------------- §2.5
def _relevant_contents(spark, sf_dir) -> DataFrame:
    """Text of the relevant files (filter on the listing columns, same scan)."""
    return C.filter_files(src.listing_with_text(spark, sf_dir)).select("repo", "path", "file_seq", "content")


def _fm(spark, sf_dir) -> DataFrame:
    return M.file_metrics(_relevant_contents(spark, sf_dir))


@query
def file_metrics(spark, sf_dir):
    return _fm(spark, sf_dir)


@query
def file_metrics_by_pieces(spark, sf_dir):
    """The same metrics with every file of over 50 letters cut into pieces."""
    return PC.file_metrics_by_pieces(_relevant_contents(spark, sf_dir), 50)


@query
def max_indentation(spark, sf_dir):
    return M.max_indentation(_relevant_contents(spark, sf_dir))


@query
def code_metrics_totals(spark, sf_dir):
    return M.code_metrics_totals(_fm(spark, sf_dir))


@query
def stream_replaced_totals(spark, sf_dir):
    """The totals kept by a stream over two landings: the second replaces
    files of the first and brings new ones."""
    root = f"{shared_dir(spark)}/tables/landing-{uuid.uuid4().hex}"
    seq = F.col("file_seq")
    texts = write_table(_relevant_contents(spark, sf_dir).withColumn("path", F.concat(F.lit("f"), seq, F.lit("/"), F.col("path"))), "texts")
    older = F.when(seq % 3 == 0, F.concat(F.lit("old\n"), F.col("content"))).when(seq % 7 == 1, F.lit("")).otherwise(F.col("content"))
    texts.where(seq % 4 != 3).withColumn("content", older).write.parquet(f"{root}/in/first")
    for later in (None, texts.where((seq % 4 == 3) | (seq % 3 == 0) | (seq % 7 == 1))):
        if later is not None:
            later.write.parquet(f"{root}/in/second")
        RS.stream_replaced_totals(spark, f"{root}/in/*", f"{root}/out", f"{root}/check").awaitTermination()
    return RS.replaced_totals(spark, f"{root}/out")


@query
def code_metrics_by_language(spark, sf_dir):
    return M.code_metrics_by_language(_fm(spark, sf_dir))


@query
def large_files(spark, sf_dir):
    return M.large_files(_fm(spark, sf_dir), 40)


@query
def deeply_nested_files(spark, sf_dir):
    return M.deeply_nested_files(_fm(spark, sf_dir))


@query
def code_metrics_basic(spark, sf_dir):
    return M.code_metrics_basic(R.collect_code_files(src.contents(spark, sf_dir)))


@query
def content_volume(spark, sf_dir):
    collected = R.collect_code_files(src.contents(spark, sf_dir))
    return M.content_volume(collected, src.responses(spark, sf_dir))


# ---------------------------------------------------------------- §2.1
@query
def read_listing(spark, sf_dir):
    """The listing written as Parquet and as JSON, and read again."""
    columns = ["repo", "file_seq", "path", "name", "type", "size"]
    out = None
    for fmt in ("parquet", "json"):
        path = f"{shared_dir(spark)}/tables/listing-{uuid.uuid4().hex}"
        src.files(spark, sf_dir).write.format(fmt).save(path)
        part = R.read_listing(spark, path, fmt).select(*columns, F.lit(fmt).alias("fmt"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def listing_pages(spark, sf_dir):
    """The reply pages landed and read by the page source; the pages of one
    repository and of a range of pages by filters that the source takes."""
    path = f"{shared_dir(spark)}/tables/pages-{uuid.uuid4().hex}"
    src.ado_listing_pages(spark, sf_dir).sortWithinPartitions("repo", "page").write.parquet(path)
    found = None
    for scope, cond in (("all", "true"), ("src3", "repo = 'src3'"), ("pages 2 to 8", "page >= 2 AND page < 9")):
        part = R.read_listing(spark, path, "listing_pages", pushdown=True).where(cond)
        part = part.select("repo", "page", "path", "size", F.lit(scope).alias("scope"))
        found = part if found is None else found.unionByName(part)
    return found


@query
def landed_tree(spark, sf_dir):
    """The paths of the files landed as text, a folder a repository and
    language, and that tree listed by the tree source."""
    path = f"{shared_dir(spark)}/tables/tree-{uuid.uuid4().hex}"
    files = C.detect_language(src.files(spark, sf_dir))
    (files.select("repo", F.coalesce("language", F.lit("none")).alias("language"), "path").repartition("repo", "language")
     .write.partitionBy("repo", "language").text(path))
    listed = R.read_listing(spark, path, "landed_tree")
    return listed.select("repo", directory_of("path").alias("directory"), "file_seq", "type", "size")


@query
def normalize_ado_listing(spark, sf_dir):
    return R.normalize_ado_listing(src.ado_listing_pages(spark, sf_dir)).select("repo", "page", "path", "size")


@query
def listing_counts(spark, sf_dir):
    return R.listing_counts(src.ado_listing_pages(spark, sf_dir))


@query
def decode_contents(spark, sf_dir):
    raw = src.raw_contents(spark, sf_dir)
    parts = [R.decode_contents(raw, m).select("repo", "file_seq", F.lit(m).alias("mode"),
                                              F.md5("content").alias("content_md5"))
             for m in ("drop", "ignore", "latin1")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def collect_code_files(spark, sf_dir):
    return R.collected_size(src.contents(spark, sf_dir))


@query
def retrieve_capped(spark, sf_dir):
    return R.retrieve_capped(src.files(spark, sf_dir)).select("repo", "file_seq", "rank")


@query
def files_by_extension(spark, sf_dir):
    return R.files_by_extension(R.collect_code_files(src.contents(spark, sf_dir)))


@query
def parse_repo_url(spark, sf_dir):
    return R.parse_repo_url(src.url_inputs(spark, sf_dir))


@query
def repo_overview(spark, sf_dir):
    return R.repo_overview(src.repos(spark, sf_dir))


@query
def repo_overview_ado(spark, sf_dir):
    repos = src.repos(spark, sf_dir)
    project = F.when(F.col("license").isNotNull(), F.element_at("topics", 2))
    branch = F.when(F.col("has_wiki"), F.concat(F.lit("refs/heads/"), F.col("default_branch")))
    return R.repo_overview_ado(repos.select("repo", project.alias("project"), "size", branch.alias("default_branch")))


@query
def language_bytes_share(spark, sf_dir):
    return R.language_bytes_share(src.repos(spark, sf_dir))


@query
def recent_commits(spark, sf_dir):
    return A.recent_commits(src.commits(spark, sf_dir))


@query
def commits_on_branch(spark, sf_dir):
    return A.commits_on_branch(src.commits(spark, sf_dir), "1-URGENT")


@query
def pull_requests_by_status(spark, sf_dir):
    prs = src.pull_requests(spark, sf_dir)
    active = A.pull_requests_by_status(prs, "active")
    every = A.pull_requests_by_status(prs, "all")
    return active.withColumn("scope", F.lit("active")).unionByName(every.withColumn("scope", F.lit("all")))


@query
def branches_per_repo(spark, sf_dir):
    return A.branches_per_repo(src.branches(spark, sf_dir))


@query
def list_org_repositories(spark, sf_dir):
    projects, repos = src.projects(spark, sf_dir), src.project_repos(spark, sf_dir)
    every = A.list_org_repositories(projects, repos).withColumn("scope", F.lit("all"))
    one = A.list_org_repositories(projects, repos, project="de").withColumn("scope", F.lit("de"))
    return every.unionByName(one)


@query
def search_code_index(spark, sf_dir):
    """The same searches, and one for two letters, through an index in two
    generations: the second brings new files, other texts and removals."""
    index = SI.Index(f"{shared_dir(spark)}/tables/search-{uuid.uuid4().hex}", 16, 32)
    texts = write_table(src.contents(spark, sf_dir).withColumn("repo", F.concat(
        F.lit("org"), F.col("file_seq") % 3, F.lit("/"), F.col("repo"))), "texts")
    seq = F.col("file_seq")
    other = F.when(seq % 10 == 1, F.reverse("content")).when(seq % 10 == 2, F.lit("KAFKA, once")).otherwise(F.col("content"))
    gone = texts.where(seq % 6 == 0).withColumn("file_seq", -1 - seq)
    SI.add_to_index(index, 0, texts.where(seq % 5 != 0).withColumn("content", other).unionByName(gone))
    SI.add_to_index(index, 1, texts.where((seq % 5 == 0) | (seq % 10).isin(1, 2)), gone)
    found = None
    for scope, text, owner, repo in (("everywhere", "KAFKA", None, None), ("owner", "KAFKA", "org1", None),
                                     ("repository", "KAFKA", "org2", "src3"), ("short", "Kq", None, None)):
        rows = SI.search_index(spark, index, text, owner, repo).withColumn("scope", F.lit(scope))
        found = rows if found is None else found.unionByName(rows)
    return found


@query
def search_code(spark, sf_dir):
    texts = src.contents(spark, sf_dir)
    owned = texts.withColumn("repo", F.concat(F.lit("org"), F.col("file_seq") % 3, F.lit("/"), F.col("repo")))
    found = A.search_code(texts, "KAFKA").withColumn("scope", F.lit("everywhere"))
    for scope, owner, repo in (("owner", "org1", None), ("repository", "org2", "src3")):
        found = found.unionByName(A.search_code(owned, "KAFKA", owner, repo).withColumn("scope", F.lit(scope)))
    return found


# ---------------------------------------------------------------- §2.6
def _flags(spark, sf_dir) -> DataFrame:
    return PT.pattern_flags(_relevant_contents(spark, sf_dir))


@query
def detect_technologies(spark, sf_dir):
    return PT.detect_technologies(_flags(spark, sf_dir))


@query
def detect_api_type(spark, sf_dir):
    return PT.detect_api_type(_flags(spark, sf_dir))


@query
def detect_project_type(spark, sf_dir):
    return PT.detect_project_type(_flags(spark, sf_dir))


@query
def detect_architecture(spark, sf_dir):
    return PT.detect_architecture(_flags(spark, sf_dir))


@query
def project_patterns(spark, sf_dir):
    p = PT.project_patterns(_flags(spark, sf_dir))
    arrays = [c for c in p.columns if c not in ("repo", "project_type", "api_type")]
    return p.select("repo", "project_type", "api_type", *[F.array_join(c, "|").alias(c) for c in arrays])


# ---------------------------------------------------------------- §2.4
def _deps(spark, sf_dir) -> DataFrame:
    return D.extract_dependencies(_relevant_contents(spark, sf_dir))


@query
def extract_dependencies(spark, sf_dir):
    return _deps(spark, sf_dir)


@query
def package_managers(spark, sf_dir):
    return D.package_managers(_relevant_contents(spark, sf_dir))


@query
def package_managers_basic(spark, sf_dir):
    return D.package_managers_basic(R.collect_code_files(src.contents(spark, sf_dir)))


@query
def dependency_totals(spark, sf_dir):
    return D.dependency_totals(_deps(spark, sf_dir))


@query
def top_dependencies(spark, sf_dir):
    return D.top_dependencies(_deps(spark, sf_dir))


@query
def identify_tooling(spark, sf_dir):
    return D.identify_tooling(_deps(spark, sf_dir))


# ---------------------------------------------------------------- §2.7
def _relevant_listing_text(spark, sf_dir) -> DataFrame:
    return C.filter_files(src.listing_with_text(spark, sf_dir))


@query
def key_files(spark, sf_dir):
    return K.key_files(_relevant_listing_text(spark, sf_dir))


def _selected(spark, sf_dir) -> DataFrame:
    return K.select_for_analysis(_relevant_contents(spark, sf_dir), src.focus_files(spark, sf_dir))


@query
def select_for_analysis(spark, sf_dir):
    return _selected(spark, sf_dir)


@query
def selection_scores(spark, sf_dir):
    return K.selection_scores(_relevant_contents(spark, sf_dir), src.focus_files(spark, sf_dir))


def _explanations(spark, sf_dir) -> DataFrame:
    return X.parse_responses(src.responses(spark, sf_dir))


def _explained(spark, sf_dir) -> DataFrame:
    """The explanations without their long texts, as a table: queries that
    read them in several branches parse each reply once."""
    return write_table(X.without_texts(_explanations(spark, sf_dir)), "explained")


@query
def report_file_order(spark, sf_dir):
    return K.report_file_order(_explanations(spark, sf_dir))


# ---------------------------------------------------------------- §2.8
def _prompts(spark, sf_dir) -> DataFrame:
    sel = _selected(spark, sf_dir).select("repo", "path")
    return X.build_prompts(matching(_relevant_contents(spark, sf_dir), sel, ["repo", "path"]))


@query
def build_prompts(spark, sf_dir):
    return _prompts(spark, sf_dir).select("repo", "path", "file_seq", "language",
                                          F.length("prompt").alias("prompt_length"),
                                          F.md5("prompt").alias("prompt_md5"))


@query
def prompt_stats(spark, sf_dir):
    return X.prompt_stats(_prompts(spark, sf_dir))


@query
def prompt_averages(spark, sf_dir):
    return X.prompt_averages(_prompts(spark, sf_dir))


@query
def parse_responses(spark, sf_dir):
    e = _explanations(spark, sf_dir)
    return e.select("repo", "path", "file_seq", "language", "status", "summary", "main_functionality",
                    "summary_short", "functionality_short", "complexity_assessment", *[F.size(f).alias(f"n_{f}") for f in X.rules.LIST_FIELDS])


def _items(spark, sf_dir) -> DataFrame:
    return X.explanation_items(_explanations(spark, sf_dir))


@query
def explanation_items(spark, sf_dir):
    return _items(spark, sf_dir)


@query
def complexity_distribution(spark, sf_dir):
    return X.complexity_distribution(_explanations(spark, sf_dir)).select("repo", "complexity", "files")


@query
def common_patterns(spark, sf_dir):
    return X.common_patterns(_items(spark, sf_dir))


@query
def key_technologies(spark, sf_dir):
    return X.key_technologies(_items(spark, sf_dir))


@query
def top_values(spark, sf_dir):
    """The most frequent patterns and dependencies, by threshold rounds over
    partial counts."""
    items, found = _items(spark, sf_dir).where("is_string"), None
    for field, n in (("code_patterns", X.rules.COMMON_PATTERNS_N), ("dependencies", X.rules.KEY_TECHNOLOGIES_N)):
        partial = write_table(TV.partial_counts(items.where(F.col("field") == field), ["repo"], n), "partial")
        rows = TV.top_values(partial, ["repo"], n).withColumn("field", F.lit(field))
        found = rows if found is None else found.unionByName(rows)
    return found


@query
def improvement_themes(spark, sf_dir):
    return X.improvement_themes(_items(spark, sf_dir))


@query
def insights_summary(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return X.insights_summary(e, X.explanation_items(e))


@query
def improvement_categories(spark, sf_dir):
    return X.improvement_categories(_items(spark, sf_dir))


@query
def complexity_groups(spark, sf_dir):
    return X.complexity_groups(_explanations(spark, sf_dir))


@query
def size_by_complexity(spark, sf_dir):
    return X.size_by_complexity(_explanations(spark, sf_dir), R.collect_code_files(src.contents(spark, sf_dir)))


@query
def dependency_usage(spark, sf_dir):
    return _texts(X.dependency_usage(X.explanation_items(_explained(spark, sf_dir))))


@query
def pattern_usage(spark, sf_dir):
    return _texts(X.pattern_usage(X.explanation_items(_explained(spark, sf_dir))))


@query
def distinct_values(spark, sf_dir):
    """Distinct string items of each field, from bitmaps of three days that
    share a growing dictionary."""
    by, items = ["repo", "field"], write_table(_items(spark, sf_dir).where("is_string").select("repo", "file_seq", "field", "value"), "items")
    known, days = None, None
    for day in range(3):
        own = items.where(F.col("file_seq") % 3 == day)
        known = write_table(DB.grown_dictionary(own, by, known=known), "dictionary")
        maps = write_table(DB.value_bitmaps(own, known, by), "bitmaps")
        days = maps if days is None else days.unionByName(maps)
    return DB.distinct_counts(days, by)


@query
def explanation_overview(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return _texts(X.explanation_overview(e, X.explanation_items(e)))


@query
def explanation_details(spark, sf_dir):
    return _texts(X.explanation_details(_explanations(spark, sf_dir)))


@query
def code_analysis_overview(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return X.code_analysis_overview(X.insights_summary(e, X.explanation_items(e)))


@query
def run_summary(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return X.run_summary(R.collect_code_files(src.contents(spark, sf_dir)), _selected(spark, sf_dir), e,
                         _prompts(spark, sf_dir), X.explanation_items(e))


@query
def analysis_success(spark, sf_dir):
    return X.analysis_success(_explanations(spark, sf_dir))


@query
def success_ratio(spark, sf_dir):
    return X.success_ratio(_explanations(spark, sf_dir))


@query
def issue_candidates(spark, sf_dir):
    items = X.explanation_items(_explained(spark, sf_dir))
    return _texts(X.issue_candidates(X.improvement_themes(items), items, src.open_issues(spark, sf_dir)))


# ---------------------------------------------------------------- §2.9
@query
def format_size(spark, sf_dir):
    return RP.format_size_table(S.structure_totals(_relevant(spark, sf_dir)))


@query
def safe_percentage(spark, sf_dir):
    return RP.safe_percentages(_relevant(spark, sf_dir))


@query
def documentation_quality(spark, sf_dir):
    return RP.documentation_quality(_relevant(spark, sf_dir))


@query
def documentation_groups(spark, sf_dir):
    return RP.documentation_groups(_relevant(spark, sf_dir))


@query
def development_workflow(spark, sf_dir):
    return RP.development_workflow(_relevant(spark, sf_dir), src.repos(spark, sf_dir))


@query
def recommendations(spark, sf_dir):
    feats = _features(spark, sf_dir)
    arch_n = PT.pattern_flags_from_hits(feats).select("repo", F.size(PT.architecture_expr()).alias("n_arch"))
    return RP.recommendations(RP.recommendation_inputs(feats, FT.metrics_from(feats), arch_n, _items(spark, sf_dir)))


@query
def technology_stack(spark, sf_dir):
    feats = _features(spark, sf_dir)
    return RP.technology_stack(PT.pattern_flags_from_hits(feats), D.package_managers_from(feats),
                               D.identify_tooling(D.dependencies_from(feats)))


@query
def quick_summary(spark, sf_dir):
    return _texts(RP.quick_summary(src.repos(spark, sf_dir), _relevant(spark, sf_dir)))


@query
def build_run_guide(spark, sf_dir):
    return RP.build_run_guide(R.collect_code_files(src.contents(spark, sf_dir)))


def _features(spark, sf_dir) -> DataFrame:
    """The feature rows of the relevant files, as a table: many branches read
    them, none of them reads text."""
    return write_table(MD.relevant_features(src.listing_with_text(spark, sf_dir)), "features")


@query
def render_report(spark, sf_dir):
    """Fragments of the full report without explanations (the report of a run
    with model analysis disabled)."""
    return MD.report_from_features(_features(spark, sf_dir), write_table(src.repos(spark, sf_dir), "repos"), None,
                                   analysis_date="2026-01-01 00:00:00")


# ---------------------------------------------------------------- upkeep
def _upkeep(spark, sf_dir, reports: bool) -> UP.Results:
    """The results now, from those of an earlier snapshot."""
    now = write_table(src.snapshot(spark, sf_dir), "snapshot")
    early = src.earlier(now)
    listing = write_table(early.drop("content"), "listing")
    blobs = f"{shared_dir(spark)}/tables/blobs-{uuid.uuid4().hex}"
    UP.write_blobs(early, blobs)
    UP.write_blobs(now, blobs, listing)
    fetch = UP.fetch_blobs(blobs)
    before = UP.Snapshot(listing, write_table(src.early_repos(spark, sf_dir), "repos"))
    after = UP.Snapshot(now.drop("content"), write_table(src.repos(spark, sf_dir), "repos"))
    first = UP.first_run(before, fetch, write_table, "2026-01-01 00:00:00")
    if reports:
        first = UP.Results(first.features, first.totals, write_table(first.report, "report"))
    return UP.refresh(first, before, after, fetch, write_table, "2026-01-01 00:00:00")


@query
def upkeep_totals(spark, sf_dir):
    return _upkeep(spark, sf_dir, False).totals


@query
def upkeep_report(spark, sf_dir):
    return _upkeep(spark, sf_dir, True).report


# ---------------------------------------------------------------- §2.11
@query
def analyze_quick(spark, sf_dir):
    return MD.analyze_quick(src.files(spark, sf_dir), src.repos(spark, sf_dir)).select("repo", "document")


@query
def analyze_full(spark, sf_dir):
    """Fragments of the full report with explanations."""
    feats = _features(spark, sf_dir)
    expl = MD.selected_explanations(feats, src.responses(spark, sf_dir), src.focus_files(spark, sf_dir))
    return MD.report_from_features(feats, write_table(src.repos(spark, sf_dir), "repos"), write_table(expl, "explanations"),
                                   analysis_date="2026-01-01 00:00:00")


def _clone(spark, sf_dir) -> dict[str, DataFrame]:
    return MD.analyze_clone(src.contents(spark, sf_dir), src.responses(spark, sf_dir), src.repos(spark, sf_dir),
                            src.open_issues(spark, sf_dir), write_table)


@query
def analyze_clone(spark, sf_dir):
    out = _clone(spark, sf_dir)
    functional = out["functional"].select("repo", F.lit("functional").alias("doc"), F.col("document").alias("text"))
    guide = out["build_and_run"].select("repo", F.lit("build_and_run").alias("doc"), F.col("guide").alias("text"))
    return functional.unionByName(guide)


@query
def clone_technical(spark, sf_dir):
    return _clone(spark, sf_dir)["technical"]


@query
def clone_insights(spark, sf_dir):
    return _clone(spark, sf_dir)["insights"]


@query
def clone_issues(spark, sf_dir):
    return _texts(_clone(spark, sf_dir)["issues"])


# ---------------------------------------------------------------- sinks: written, then read back
@query
def write_reports(spark, sf_dir):
    path = f"{shared_dir(spark)}/tables/reports-{uuid.uuid4().hex}"
    docs = MD.analyze_quick(src.files(spark, sf_dir), src.repos(spark, sf_dir))
    sinks.write_reports(docs.select("repo", F.col("document").alias("report")), path)
    lines = spark.read.text(path).select("repo", "doc", "value")
    return lines.groupBy("repo", "doc").agg(F.count(F.lit(1)).alias("lines"),
                                            F.sum(F.length("value")).cast("bigint").alias("chars"))


@query
def write_results_json(spark, sf_dir):
    path = f"{shared_dir(spark)}/tables/results-{uuid.uuid4().hex}"
    insights = _clone(spark, sf_dir)["insights"]
    sinks.write_results_json(insights, path)
    return spark.read.schema(insights.schema).json(path)


# ---------------------------------------------------------------- §2.4 single parsers
def _parser_query(fn_name: str):
    def run(spark, sf_dir):
        return getattr(D, fn_name)(_relevant_contents(spark, sf_dir))
    run.__name__ = fn_name
    return run


for _fn in ("deps_npm", "deps_pip", "deps_pipenv", "deps_poetry", "deps_cargo", "deps_go", "deps_maven",
            "deps_bundler", "deps_composer"):
    query(_parser_query(_fn))


@query
def issue_candidates_ado(spark, sf_dir):
    """The work-item variant: no check against open issue titles."""
    items = X.explanation_items(_explained(spark, sf_dir))
    return _texts(X.issue_candidates(X.improvement_themes(items), items, None))


@query
def file_metrics_html(spark, sf_dir):
    """Line metrics of the web pages as .html files (the '<!--' comment rule)."""
    return M.file_metrics(src.pages_files(spark, sf_dir))


FLAGSHIP = "language_distribution"
