"""§2.1 Sources: listings, raw listing replies, text decoding, file
collection and capped retrieval, URL parsing and repository metadata."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions.paths import name_of, suffix_of
from codecensus.functions import sql as S
from codecensus.functions.ranks import gapless_rank
from codecensus.operators.classify import lookup
from codecensus.sources.listing_sources import register

ADO_ITEMS = "struct<value: array<struct<path: string, isFolder: boolean, size: bigint>>>"


def read_listing(spark: SparkSession, path: str, fmt: str = "parquet", repo: str | None = None, pushdown: bool = False,
                 repos: list[str] | None = None) -> DataFrame:
    """A file listing from a table, parquet/json files, a landed tree, or
    landed reply pages.

    ``fmt='landed_tree'`` lists a tree of repositories by directory, of
    ``repos`` if given; ``fmt='listing_pages'`` the files of landed listing
    replies, with ``pushdown`` for the one set of filters that follows.
    ``fmt='binaryFile'`` lists a directory tree recursively; only the path
    and length columns are selected, so file bodies are never read.
    """
    if fmt == "table":
        return spark.table(path)
    if fmt == "landed_tree":
        register(spark)
        return spark.read.format(fmt).option("repos", json.dumps(repos)).load(path).transform(_in_path_order)
    if fmt == "listing_pages":
        register(spark)
        return spark.read.format(fmt).option("pushdown", pushdown).load(path).where(~F.col("is_folder")).drop("is_folder")
    if fmt != "binaryFile":
        return spark.read.format(fmt).load(path)
    root = path.rstrip("/") + "/"
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
               .select("path", "length"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:", ""), "^" + _re_quote(root.replace("file:", "")), "")
    return df.select(
        F.lit(repo).alias("repo") if repo else F.regexp_extract(rel, r"^([^/]+)", 1).alias("repo"),
        (rel if repo else F.regexp_replace(rel, r"^[^/]+/", "")).alias("path"),
        F.lit("file").alias("type"),
        F.col("length").alias("size"),
    ).withColumn("name", name_of("path")).transform(_in_path_order)


def _in_path_order(files: DataFrame) -> DataFrame:
    """``file_seq``: the place of a path among those of its repository."""
    return gapless_rank(files, ["repo"], F.col("path"), rank="file_seq")


def _re_quote(s: str) -> str:
    import re
    return re.escape(s)


def normalize_ado_listing(raw: DataFrame) -> DataFrame:
    """Raw replies (repo, page, json) -> files (repo, page, pos, path, size):
    explode ``value``, keep ``isFolder = false`` (absent counts as folder),
    strip leading '/'."""
    items = raw.select("repo", "page", F.posexplode(F.from_json("json", ADO_ITEMS)["value"]).alias("pos", "it"))
    return (items.where(~F.coalesce(F.col("it.isFolder"), F.lit(True)))
                 .select("repo", "page", "pos",
                         F.regexp_replace(F.coalesce(F.col("it.path"), F.lit("")), "^/+", "").alias("path"),
                         F.coalesce(F.col("it.size"), F.lit(0)).alias("size")))


def listing_counts(raw: DataFrame) -> DataFrame:
    """(repo, file_count, folder_count): isFolder false / true; absent counts in neither."""
    items = raw.select("repo", F.explode(F.from_json("json", ADO_ITEMS)["value"]).alias("it"))
    f = F.col("it.isFolder")
    return items.groupBy("repo").agg(F.count_if(~F.coalesce(f, F.lit(True))).alias("file_count"),
                                     F.count_if(F.coalesce(f, F.lit(False))).alias("folder_count"))


def decode_contents(raw: DataFrame, on_error: str = "drop") -> DataFrame:
    """Binary or base64 text -> ``content``.

    on_error: 'drop' removes files that are not valid UTF-8, 'ignore' removes
    the invalid bytes, 'latin1' decodes such files as ISO-8859-1.
    """
    data = F.when(F.col("encoding") == "base64", F.unbase64(F.col("raw").cast("string"))).otherwise(
        F.col("raw").cast("binary"))
    as_text = data.cast("string")
    valid = F.is_valid_utf8(as_text)
    if on_error == "drop":
        return raw.withColumn("content", as_text).where(valid).drop("raw", "encoding")
    if on_error == "ignore":
        # genuine U+FFFD characters step aside, as a mark and a digit, while
        # the repaired ones go; the mark itself is written as mark and 0
        mark, bad = "\U0010fffe", "\ufffd"
        aside = F.replace(F.replace(as_text, F.lit(mark), F.lit(mark + "0")), F.lit(bad), F.lit(mark + "1"))
        whole = F.replace(F.make_valid_utf8(aside), F.lit(bad), F.lit(""))
        fixed = F.replace(F.replace(whole, F.lit(mark + "1"), F.lit(bad)), F.lit(mark + "0"), F.lit(mark))
        return raw.withColumn("content", F.when(valid, as_text).otherwise(fixed)).drop("raw", "encoding")
    if on_error == "latin1":
        return raw.withColumn("content", F.when(valid, as_text).otherwise(
            F.decode(data, "ISO-8859-1"))).drop("raw", "encoding")
    raise ValueError(f"unknown on_error mode: {on_error}")


def _collectable(path: str) -> Column:
    return S.expr(f"({S.map_lookup(rules.CODE_EXTENSIONS, S.suffix(path))} IS NOT NULL "
                  f"OR {S.in_list('lower(' + S.name(path) + ')', rules.COLLECT_EXTRA_NAMES)})")


def collect_code_files(contents: DataFrame) -> DataFrame:
    """Files a local walk keeps: the 20 code extensions plus four manifest
    names (compared lower-cased, so 'Dockerfile', 'Makefile', 'README.md'
    in the list never match)."""
    return contents.where(_collectable("path"))


def collected_size(contents: DataFrame) -> DataFrame:
    """(repo, collected_files, total_size) of the collected files."""
    return collect_code_files(contents).groupBy("repo").agg(
        F.count(F.lit(1)).alias("collected_files"),
        F.sum(F.length("content")).cast("bigint").alias("total_size"))


def retrieve_capped(listing: DataFrame, max_files: int | None = None, max_chars: int | None = None,
                    max_dir_depth: int | None = None) -> DataFrame:
    """(repo, path, file_seq, rank): the code files of each repository in
    listing order. Without limits all of them; ``max_files`` keeps the first
    ones, ``max_chars`` those with a smaller ``size``, ``max_dir_depth``
    those at most that many directories deep. Only the listing is read;
    texts are joined to the result on (repo, path).
    """
    keep = lookup(rules.CODE_EXTENSIONS, S.suffix("path")).isNotNull()
    if max_chars is not None:
        keep = keep & (F.coalesce("size", F.lit(0)) < max_chars)
    if max_dir_depth is not None:
        keep = keep & (F.size(F.split("path", "/")) <= max_dir_depth + 1)
    code = listing.where(keep).select("repo", "path", "file_seq")
    if max_files is None:
        return gapless_rank(code, ["repo"], F.col("file_seq"))
    w = Window.partitionBy("repo").orderBy("file_seq")
    return code.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= max_files)


def files_by_extension(contents: DataFrame) -> DataFrame:
    """(repo, extension, language, files, total_chars); language 'Unknown' when
    the extension is not a code extension."""
    ext = suffix_of("path")
    return (contents.select("repo", ext.alias("extension"), F.length("content").alias("n"))
                    .groupBy("repo", "extension")
                    .agg(F.count(F.lit(1)).alias("files"), F.sum("n").cast("bigint").alias("total_chars"))
                    .withColumn("language", F.coalesce(lookup(rules.CODE_EXTENSIONS, F.col("extension")),
                                                       F.lit("Unknown"))))


GITHUB_TOOL_RE = r"^https://github\.com/([^/]+)/([^/]+)"
ADO_RE = r"^https://dev\.azure\.com/([^/]+)/([^/]+)/_git/([^/]+)"
ADO_OLD_RE = r"^https://([^.]+)\.visualstudio\.com/([^/]+)/_git/([^/]+)"


def parse_repo_url(urls: DataFrame, col: str = "url", compat: bool = False) -> DataFrame:
    """Adds platform, owner, project, repo_name, repo_path, error.

    GitHub: 'https://github.com/o/r' or 'o/r' (exactly one '/'); the tool
    form (pattern anchored at the start) also gives owner and repository.
    Azure DevOps: dev.azure.com/org/project/_git/repo or the older
    org.visualstudio.com form. ``compat`` strips the characters of '.git'
    from the end as the original did ('widget.git' -> 'widge'); by default
    only a '.git' suffix is removed.
    """
    u = F.col(col)
    gh_path = F.regexp_replace(F.replace(u, F.lit("https://github.com/"), F.lit("")), "/+$", "")
    is_gh_url = u.startswith("https://github.com/")
    is_short = u.contains("/") & ~u.startswith("http")
    repo_path = F.when(is_gh_url, gh_path).when(is_short, u)
    n_slash = F.length(repo_path) - F.length(F.replace(repo_path, F.lit("/"), F.lit("")))
    ado = F.regexp_extract(u, ADO_RE, 1) != ""
    ado_old = F.regexp_extract(u, ADO_OLD_RE, 1) != ""

    def grp(rx, i):
        return F.regexp_extract(u, rx, i)

    gh_repo_raw = grp(GITHUB_TOOL_RE, 2)
    gh_repo = (F.regexp_replace(gh_repo_raw, "[.git]+$", "") if compat
               else F.regexp_replace(gh_repo_raw, r"\.git$", ""))
    platform = (F.when(ado, "azure_devops").when(ado_old, "azure_devops")
                .when(repo_path.isNotNull() & (n_slash == 1), "github"))
    error = (F.when(platform.isNotNull(), F.lit(None).cast("string"))
             .when(repo_path.isNull(), F.concat(F.lit("Invalid repository URL format: "), u))
             .otherwise(F.concat(F.lit("Invalid repository path format: "), repo_path)))
    owner = (F.when(ado, grp(ADO_RE, 1)).when(ado_old, grp(ADO_OLD_RE, 1))
             .when(platform == "github", F.split_part(repo_path, F.lit("/"), F.lit(1))))
    project = F.when(ado, grp(ADO_RE, 2)).when(ado_old, grp(ADO_OLD_RE, 2))
    name = (F.when(ado, grp(ADO_RE, 3)).when(ado_old, grp(ADO_OLD_RE, 3))
            .when(platform == "github",
                  F.when(is_gh_url & (gh_repo_raw != ""), gh_repo)
                   .otherwise(F.split_part(repo_path, F.lit("/"), F.lit(2)))))
    return urls.select("*", platform.alias("platform"), owner.alias("owner"), project.alias("project"),
                       name.alias("repo_name"), F.when(platform == "github", repo_path).alias("repo_path"),
                       error.alias("error"))


def repo_overview(repos: DataFrame) -> DataFrame:
    """Report header fields with the report's defaults."""
    return repos.select(
        "repo",
        F.coalesce("repo", F.lit("Unknown Repository")).alias("name"),
        F.coalesce("description", F.lit("No description available")).alias("description"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("language", F.lit("Not specified")).alias("language"),
        F.coalesce("stars", F.lit(0)).cast("bigint").alias("stars"),
        F.coalesce("forks", F.lit(0)).cast("bigint").alias("forks"),
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size_kb"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("Unknown")).alias("created"),
        F.coalesce(F.date_format("updated_at", "yyyy-MM-dd"), F.lit("Unknown")).alias("updated"),
        F.array_join(F.coalesce("topics", F.array().cast("array<string>")), ", ").alias("topics"),
        F.col("license"),
        F.coalesce("has_issues", F.lit(False)).alias("has_issues"),
        F.coalesce("has_projects", F.lit(False)).alias("has_projects"),
        F.coalesce("has_wiki", F.lit(False)).alias("has_wiki"))


def repo_overview_ado(repos: DataFrame) -> DataFrame:
    """Azure DevOps metadata: name, project, size in bytes, default branch
    (without 'refs/heads/'), with 'Unknown' and 0 where they are missing."""
    return repos.select(
        "repo", F.coalesce("repo", F.lit("Unknown")).alias("name"),
        F.coalesce("project", F.lit("Unknown")).alias("project"),
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        F.regexp_replace(F.coalesce("default_branch", F.lit("Unknown")), "^refs/heads/", "").alias("default_branch"))


def language_bytes_share(repos: DataFrame, n: int = rules.TOP_LANGUAGE_BYTES) -> DataFrame:
    """(repo, rank, language, bytes, pct): top N languages by bytes."""
    e = repos.select("repo", F.explode("languages").alias("language", "bytes"))
    w_all = Window.partitionBy("repo")
    w = Window.partitionBy("repo").orderBy(F.col("bytes").desc(), F.col("language"))
    return (e.withColumn("pct", F.col("bytes") / F.sum("bytes").over(w_all) * 100)
             .withColumn("rank", F.row_number().over(w))
             .where(F.col("rank") <= n)
             .select("repo", "rank", "language", F.col("bytes").cast("bigint").alias("bytes"), "pct"))
