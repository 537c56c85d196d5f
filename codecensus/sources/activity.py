"""§2.1 Activity tables: commits, pull requests, branches, organisation
repositories and code search. Lists come back whole, each row with its rank
and the number of rows; pages are cut only where a caller asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions.ranks import gapless_rank


def recent_commits(commits: DataFrame, n: int = rules.RECENT_COMMITS) -> DataFrame:
    """(repo, rank, sha, message, author, date, url): newest N, 8-character sha,
    first line of the message."""
    w = Window.partitionBy("repo").orderBy(F.col("date").desc(), F.col("sha"))
    return (commits.select("repo", "sha", "message", "author", "date", "url")
                   .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                   .select("repo", "rank", F.substring("sha", 1, rules.SHA_CHARS).alias("sha"),
                           F.substring_index("message", "\n", 1).alias("message"), "author",
                           F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "url"))


def _paged(rows: DataFrame, key: Column, page: int | None, per_page: int | None) -> DataFrame:
    """Ranks within the repository (``rank``), the number of its rows
    (``count``), and one page of them if ``per_page`` is given."""
    ranked = gapless_rank(rows, ["repo"], key, count="count")
    if per_page is None:
        return ranked
    first = ((page or 1) - 1) * per_page
    return ranked.where((F.col("rank") > first) & (F.col("rank") <= first + per_page))


def commits_on_branch(commits: DataFrame, branch: str, page: int | None = None,
                      per_page: int | None = None) -> DataFrame:
    """A branch's commits, newest first, with their number."""
    rows = commits.where(F.col("branch") == branch).select("repo", "sha", "message", "date")
    newest = F.struct((-F.unix_micros(F.col("date").cast("timestamp"))).alias("age"), "sha")
    ranked = _paged(rows, newest, page, per_page)
    return ranked.select("repo", F.lit(branch).alias("branch"), "rank", "sha",
                         F.substring_index("message", "\n", 1).alias("message"), "count")


def pull_requests_by_status(prs: DataFrame, status: str = "active", page: int | None = None,
                            per_page: int | None = None) -> DataFrame:
    """Pull requests in a state ('all' for every state), newest first."""
    rows = prs if status == "all" else prs.where(F.col("status") == status)
    ranked = _paged(rows, -F.col("pr_id"), page, per_page)
    return ranked.select("repo", "rank", "pr_id", "title", "status", "count")


def branches_per_repo(branches: DataFrame, page: int | None = None, per_page: int | None = None) -> DataFrame:
    """Branches per repository (by name), with their number."""
    ranked = _paged(branches, F.col("branch"), page, per_page)
    return ranked.select("repo", "rank", "branch", "count")


def list_org_repositories(projects: DataFrame, project_repos: DataFrame,
                          project: str | None = None) -> DataFrame:
    """(project, repo, count): repositories of one project, or of every listed
    project tagged with its name, and how many the project has. Entries whose
    project is not listed are skipped."""
    rows = (project_repos.where(F.col("project") == project) if project is not None
            else project_repos.join(projects, "project", "left_semi")).select("project", "repo")
    return rows.join(rows.groupBy("project").agg(F.count(F.lit(1)).alias("count")), "project")


def search_code(contents: DataFrame, text: str, owner: str | None = None, repo: str | None = None) -> DataFrame:
    """(repo, path, file_seq): all files whose text contains ``text``
    (case-insensitive), in one repository, in all of an owner's (the part of
    ``repo`` before its first '/'), or anywhere."""
    hits = contents.where(F.lower("content").contains(text.lower()))
    if repo is not None:
        hits = hits.where(F.col("repo") == (f"{owner}/{repo}" if owner else repo))
    elif owner is not None:
        hits = hits.where(F.split_part("repo", F.lit("/"), F.lit(1)) == owner)
    return hits.select("repo", "path", "file_seq")
