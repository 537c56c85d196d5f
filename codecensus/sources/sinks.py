"""§2.1 Sinks: Markdown documents and JSON results, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, path: str, doc_col: str = "report", doc_name: str = "report",
                  mode: str = "overwrite") -> None:
    """One Markdown document per repository: ``path/repo=<r>/doc=<name>/part-*.txt``.

    ``reports`` is either one row per repository (``doc_col`` holds the whole
    document) or the fragments of ``reports.report_fragments`` (columns
    section, part, ord, text). Fragments are dealt out by ranges of their
    order and streamed out line by line: no document is held as one value,
    and a very large one becomes several part files, in order. The text
    writer ends each file with a newline.
    """
    if "section" in reports.columns:
        out = (reports.select("repo", F.lit(doc_name).alias("doc"), "section", "part", "ord",
                              F.regexp_replace("text", r"\n\z", "").alias("value"))
                      .repartitionByRange("repo", "section", "part", "ord")
                      .sortWithinPartitions("repo", "doc", "section", "part", "ord")
                      .select("repo", "doc", "value"))
    else:
        out = reports.select("repo", F.lit(doc_name).alias("doc"), F.col(doc_col).alias("value")).repartition("repo")
    out.write.mode(mode).partitionBy("repo", "doc").text(path)


def write_results_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Results as JSON lines with nested records kept as nested objects."""
    df.write.mode(mode).json(path)
