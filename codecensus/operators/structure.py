"""§2.3 Structure aggregations over a file listing.

Every aggregate is ``groupBy(repo, ...)`` with partial (map-side) aggregation,
so a repository holding a third of all files still moves only its partial
counts. Top-N outputs use ``row_number() <= N``, which Spark executes as a
window group limit (local top-N before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions import sql as SQ
from codecensus.functions.paths import directory_of, name_of, suffix_of
from codecensus.operators.classify import category_flags, basic_category_flags, lookup


def structure_totals(files: DataFrame) -> DataFrame:
    """(repo, total_files, total_size)."""
    return files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum(F.coalesce(F.col("size"), F.lit(0))).cast("bigint").alias("total_size"))


def language_counts(files: DataFrame, vocabulary: dict | None = None) -> DataFrame:
    """(repo, language, files, first_seq) for recognised files."""
    voc = rules.LANGUAGE_EXTENSIONS if vocabulary is None else vocabulary
    return (files.select("repo", "file_seq", lookup(voc, SQ.suffix("path")).alias("language"))
                 .where(F.col("language").isNotNull())
                 .groupBy("repo", "language")
                 .agg(F.count(F.lit(1)).alias("files"), F.min("file_seq").alias("first_seq")))


def language_distribution(files: DataFrame, width: int = rules.PROGRESS_WIDTH) -> DataFrame:
    """(repo, language, files, pct, bar_len): share of recognised files.

    The share is over the already aggregated rows (at most 42 per repo), so
    the per-repo window is tiny.
    """
    lc = language_counts(files)
    total = F.sum("files").over(Window.partitionBy("repo"))
    pct = F.col("files") / total * 100
    return lc.select("repo", "language", "files", pct.alias("pct"),
                     F.floor(width * pct / 100).cast("int").alias("bar_len"))


def extension_distribution(files: DataFrame) -> DataFrame:
    """(repo, extension, files); files without suffix count as 'no_extension'."""
    ext = F.coalesce(F.nullif(suffix_of("path"), F.lit("")), F.lit("no_extension"))
    return files.groupBy("repo", ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"))


def directory_listing(files: DataFrame) -> DataFrame:
    """(repo, directory, file_seq, name): names per directory in listing order.

    Kept as long rows; ordering is by ``file_seq`` so no group is gathered.
    """
    return files.select("repo", directory_of("path").alias("directory"), "file_seq",
                        name_of("path").alias("name"))


def directory_distribution(files: DataFrame, n: int | None = rules.TOP_DIRECTORIES) -> DataFrame:
    """(repo, directory, files, rank): directories by file count, first-seen on ties."""
    agg = files.groupBy("repo", directory_of("path").alias("directory")).agg(
        F.count(F.lit(1)).alias("files"), F.min("file_seq").alias("first_seq"))
    w = Window.partitionBy("repo").orderBy(F.col("files").desc(), F.col("first_seq"))
    ranked = agg.withColumn("rank", F.row_number().over(w))
    if n is not None:
        ranked = ranked.where(F.col("rank") <= n)
    return ranked.select("repo", "directory", "files", "rank")


def depth_histogram(files: DataFrame) -> DataFrame:
    """(repo, depth, files) with depth = number of path parts - 1."""
    depth = (F.size(F.split("path", "/")) - 1).cast("int")
    return files.groupBy("repo", depth.alias("depth")).agg(F.count(F.lit(1)).alias("files"))


def largest_files(files: DataFrame, n: int = rules.TOP_LARGEST, order_col: str = "file_seq") -> DataFrame:
    """(repo, rank, path, size): the N largest files, stable on listing order."""
    size = F.coalesce(F.col("size"), F.lit(0))
    w = Window.partitionBy("repo").orderBy(size.desc(), F.col(order_col))
    return (files.select("repo", "path", size.alias("size"), order_col)
                 .withColumn("rank", F.row_number().over(w))
                 .where(F.col("rank") <= n)
                 .select("repo", "rank", "path", "size"))


def category_files(files: DataFrame, flags: dict | None = None) -> DataFrame:
    """(repo, category, file_seq, path): one row per file and matching category."""
    fl = category_flags("path") if flags is None else flags
    cats = F.array_compact(F.array(*[F.when(fl[c], F.lit(c)) for c in rules.CATEGORIES]))
    return (files.select("repo", "file_seq", "path", F.explode(cats).alias("category"))
                 .select("repo", "category", "file_seq", "path"))


def category_counts(files: DataFrame, flags: dict | None = None) -> DataFrame:
    """(repo, category, files) for categories with at least one file.

    The five flags are summed in one pass (no explode, no row growth).
    """
    fl = category_flags("path") if flags is None else flags
    wide = files.groupBy("repo").agg(
        *[F.count_if(fl[c]).alias(c) for c in rules.CATEGORIES])
    stacked = wide.select("repo", F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).alias("files")) for c in rules.CATEGORIES
    ])).alias("s"))
    return stacked.select("repo", "s.category", "s.files").where(F.col("files") > 0)


def _characters(files: DataFrame) -> Column:
    """The length of the text, or the column that holds it already."""
    return F.col("size") if "size" in files.columns else F.length("content")


def structure_basic(contents: DataFrame) -> DataFrame:
    """Clone flow totals per repo: files, characters and the five basic
    category counts (code-extension vocabulary)."""
    fl = basic_category_flags("path")
    return contents.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum(_characters(contents)).cast("bigint").alias("total_size"),
        *[F.count_if(fl[c]).alias(f"{c}_files") for c in rules.CATEGORIES])


def languages_basic(contents: DataFrame) -> DataFrame:
    """(repo, language, files) with the 20-extension code vocabulary."""
    return (contents.select("repo", lookup(rules.CODE_EXTENSIONS, SQ.suffix("path")).alias("language"))
                    .where(F.col("language").isNotNull())
                    .groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files")))


def largest_basic(contents: DataFrame, n: int = rules.TOP_LARGEST) -> DataFrame:
    """(repo, rank, path, size): top N by characters (collection order on ties)."""
    sized = contents.select("repo", "path", "file_seq", _characters(contents).cast("bigint").alias("size"))
    return largest_files(sized, n)


def analysis_metadata(listing: DataFrame, analysed: DataFrame, quick: bool = False,
                      include_contents: bool = True, explanations_enabled: bool = True) -> DataFrame:
    """(repo, total_files_found, files_analyzed, quick_analysis, include_file_contents,
    llm_analysis_enabled)."""
    found = listing.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files_found"))
    kept = analysed.groupBy("repo").agg(F.count(F.lit(1)).alias("files_analyzed"))
    return (found.join(kept, "repo", "left")
                 .select("repo", "total_files_found",
                         F.coalesce("files_analyzed", F.lit(0)).alias("files_analyzed"),
                         F.lit(quick).alias("quick_analysis"),
                         F.lit(include_contents).alias("include_file_contents"),
                         F.lit(explanations_enabled and include_contents).alias("llm_analysis_enabled")))
