"""Upkeep of the full analysis from one snapshot of the listings to the next.

A snapshot is a listing with each file's ``sha`` and the repository records.
Comparing two listings tells which files are new, changed, gone or kept;
texts are fetched for new and changed files only. Feature rows of kept files
stay as they are, per-repository totals take the rows of gone and changed
files back and add the new ones, and a report is rendered again only where a
repository's files, their order or its record changed. The results equal
those of a full run over the later snapshot.

``fetch`` turns keys (repo, path, nth, sha) into (repo, path, nth, content);
``keep`` writes a table that several branches read (``session.write_table``).
A path that a listing holds more than once is matched by occurrence (``nth``
in listing order); a file without text has NULL content.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions.key_filter import matching, may_match
from codecensus.functions.paths import directory_of, parts_of, suffix_of
from codecensus.operators import classify as C
from codecensus.operators.patterns import FLAG_OF, TERMS
from codecensus.plans import features as FT
from codecensus.plans import modes as MD

KEYS = ["repo", "path", "nth"]
Fetch = Callable[[DataFrame], DataFrame]
Keep = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Snapshot:
    """``listing`` (repo, file_seq, path, name, type, size, sha) and ``repos``."""

    listing: DataFrame
    repos: DataFrame


@dataclass(frozen=True)
class Results:
    """Feature rows of the relevant files, totals (repo, measure, key, n, v)
    and the report's fragments."""

    features: DataFrame
    totals: DataFrame
    report: DataFrame


def numbered(listing: DataFrame) -> DataFrame:
    return listing.withColumn("nth", F.row_number().over(Window.partitionBy("repo", "path").orderBy("file_seq")))


def listing_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, nth, status, moved): every file of either listing as
    added, removed, changed or kept; ``moved`` where a kept file's place in
    the listing differs."""
    def side(listing: DataFrame, name: str) -> DataFrame:
        return numbered(listing).select(*KEYS, F.struct("sha", "type", "size").alias(name), F.col("file_seq").alias(f"{name}_seq"))

    both = side(before, "old").join(side(after, "new"), KEYS, "full")
    status = (F.when(F.col("old_seq").isNull(), "added").when(F.col("new_seq").isNull(), "removed")
              .when(F.col("old").eqNullSafe(F.col("new")), "kept").otherwise("changed"))
    return both.select(*KEYS, status.alias("status"), (F.col("old_seq") != F.col("new_seq")).alias("moved"))


def features_of(listing: DataFrame, fetch: Fetch) -> DataFrame:
    """Feature rows of the relevant files of a numbered listing."""
    relevant = C.filter_files(listing)
    texts = fetch(relevant.select(*KEYS, "sha")).select(*KEYS, "content")
    return FT.file_features(relevant.join(texts, KEYS, "left"), ("nth",))


def _packages(scope: str) -> Column:
    return F.size(F.filter("dep_items", lambda d: d["scope"] == scope))


def contributions(features: DataFrame) -> DataFrame:
    """(repo, measure, key, n, v): what each file adds to its repository's
    totals, summed. Measures are ``files``, ``language``, ``extension``,
    ``directory``, ``depth`` and ``category`` (n files, v bytes), the line
    classes by language (n files, v lines), ``term`` (n files whose text holds
    it), ``manager`` (n manifests) and ``package`` (n dependencies)."""
    def entry(measure: str, key: Column, n: Column, v: Column, cond: Column | None = None) -> Column:
        s = F.struct(F.lit(measure).alias("measure"), key.cast("string").alias("key"), n.cast("bigint").alias("n"), v.cast("bigint").alias("v"))
        return s if cond is None else F.when(cond, s)

    one, zero, size = F.lit(1), F.lit(0), F.coalesce("size", F.lit(0))
    language, flags = F.col("language"), C.category_flags("path")
    measured = language.isNotNull() & (F.col("chars") > 0)
    entries = [
        entry("files", F.lit(""), one, size),
        entry("language", language, one, size, language.isNotNull()),
        entry("extension", F.coalesce(F.nullif(suffix_of("path"), F.lit("")), F.lit("no_extension")), one, size),
        entry("directory", directory_of("path"), one, size),
        entry("depth", F.size(parts_of("path")) - 1, one, size),
        *[entry("category", F.lit(c), one, size, flags[c]) for c in rules.CATEGORIES],
        *[entry(m, language, one, F.col(m), measured) for m in FT.METRICS[:-1]],
        *[entry("term", F.lit(t), one, zero, F.col(FLAG_OF[t])) for t in TERMS],
        entry("manager", F.col("pm_entry"), one, zero, F.col("pm_entry").isNotNull()),
        *[entry("package", F.concat("dep_manager", F.lit(f":{scope}")), _packages(scope), zero, F.col("dep_items").isNotNull())
          for scope in ("prod", "dev")],
    ]
    rows = features.select("repo", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("repo", "e.*")
    return _summed(rows)


def _summed(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("repo", "measure", "key").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
            .where((F.col("n") != 0) | (F.col("v") != 0)))


def moved_totals(totals: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Totals after taking the feature rows ``gone`` back and adding ``new``."""
    taken = contributions(gone).select("repo", "measure", "key", (-F.col("n")).alias("n"), (-F.col("v")).alias("v"))
    return _summed(totals.unionByName(contributions(new)).unionByName(taken))


def first_run(at: Snapshot, fetch: Fetch, keep: Keep, analysis_date: str = "1970-01-01 00:00:00") -> Results:
    """The full analysis of one snapshot."""
    feats = keep(features_of(numbered(at.listing), fetch), "features")
    return Results(feats, contributions(feats), MD.report_from_features(feats, at.repos, None, analysis_date))


def _changed_records(before: DataFrame, after: DataFrame) -> DataFrame:
    def record(repos: DataFrame, name: str) -> DataFrame:
        return repos.select("repo", F.to_json(F.struct("*")).alias(name))

    both = record(before, "old").join(record(after, "new"), "repo", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("repo")


def refresh(results: Results, before: Snapshot, after: Snapshot, fetch: Fetch, keep: Keep,
            analysis_date: str = "1970-01-01 00:00:00") -> Results:
    """The results at ``after`` from those at ``before``."""
    listing = numbered(after.listing)
    delta = keep(listing_delta(before.listing, after.listing), "delta")
    same = delta.where(F.col("status") == "kept").select(*KEYS)
    fresh = delta.where(F.col("status").isin("added", "changed")).select(*KEYS)

    new = keep(features_of(listing.join(fresh, KEYS, "left_semi"), fetch), "new-features")
    stay = (results.features.join(same, KEYS, "left_semi").drop("file_seq")
            .join(listing.select(*KEYS, "file_seq"), KEYS).select(*results.features.columns))
    gone = results.features.join(same, KEYS, "left_anti")
    feats = keep(stay.unionByName(new), "features")

    touched = keep(delta.where((F.col("status") != "kept") | F.col("moved")).select("repo")
                   .unionByName(_changed_records(before.repos, after.repos)).distinct(), "touched")
    again = MD.report_from_features(keep(feats.join(touched, "repo", "left_semi"), "touched-features"),
                                    keep(after.repos.join(touched, "repo", "left_semi"), "touched-repos"), None, analysis_date)
    report = results.report.join(touched, "repo", "left_anti").unionByName(again)
    return Results(feats, moved_totals(results.totals, gone, new), report)


# ---------------------------------------------------------------- texts by their sha
SLOT_DIGITS = 2


def write_blobs(contents: DataFrame, path: str, held: DataFrame | None = None) -> None:
    """A store of texts (sha, content) in folders by the first digits of the
    sha. A store that holds the texts of ``held`` (sha) gets the others only,
    and no text that it holds is moved."""
    texts = contents.select("sha", "content")
    if held is not None:
        texts = matching(texts, texts.select("sha").join(held.select("sha"), "sha", "left_anti"), ["sha"])
    (texts.dropDuplicates(["sha"]).withColumn("slot", F.substring("sha", 1, SLOT_DIGITS))
     .repartition("slot").write.mode("append" if held is not None else "error").partitionBy("slot").parquet(path))


def fetch_blobs(path: str) -> Fetch:
    """Texts of a store; only the folders that hold an asked sha are read, and
    only texts whose sha may be asked are moved."""
    def fetch(keys: DataFrame) -> DataFrame:
        asked = keys.withColumn("slot", F.substring("sha", 1, SLOT_DIGITS))
        # at most 16 ** SLOT_DIGITS rows; Spark prunes partitions at run time only
        # where the asking side has a selective predicate
        slots = asked.select("slot").where(F.length("slot") == SLOT_DIGITS).distinct()
        blobs = keys.sparkSession.read.schema("sha string, content string, slot string").parquet(path)
        found = may_match(blobs.join(F.broadcast(slots), "slot", "left_semi"), asked, ["sha"])
        return found.join(asked, ["slot", "sha"]).select(*KEYS, "content")

    return fetch
