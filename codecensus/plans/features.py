"""One pass over the text: a narrow per-file feature table.

Every text-dependent quantity of the full analysis is computed inside the
file's own row in a single projection — line classes, keyword hits for the
pattern rules, parsed manifest rows, the selection features — so the text is
read once and never shuffled. Everything downstream (rankings, limits,
aggregations, reports) works on these narrow rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions import sql as S
from codecensus.functions.text import lines_of
from codecensus.operators.classify import language_of
from codecensus.operators.dependencies import manifest_columns
from codecensus.operators.metrics import metric_columns
from codecensus.operators.patterns import term_hit_columns

LISTING = ["repo", "file_seq", "path", "name", "type", "size"]
METRICS = ["lines", "blank_lines", "comment_lines", "code_lines", "max_indentation"]


def file_features(listing_text: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Listing columns (and those of ``also``) plus per-file features;
    ``content`` is dropped."""
    content = F.col("content")
    base = listing_text.select(
        *LISTING, *also, "content", language_of("path").alias("language"))
    staged = base.select("*", lines_of(content).alias("_lines"),
                         F.lower(F.coalesce(content, F.lit(""))).alias("lc"))
    measurable = F.col("language").isNotNull() & (F.length(content) > 0)
    metrics = [F.when(measurable, c) for c in metric_columns(F.col("_lines"), F.col("language"))]
    return staged.select(
        *LISTING, *also, "language",
        content.isNotNull().alias("has_text"),
        F.length(content).alias("chars"),
        F.when(content.isNotNull(), F.size("_lines")).alias("n_lines"),
        *[m.alias(n) for m, n in zip(metrics, METRICS)],
        S.expr(S.contains_any("lc", rules.SEL_KEYWORDS)).alias("has_keyword"),
        *term_hit_columns(),
        *manifest_columns(F.col("name"), content))


def metrics_from(features: DataFrame) -> DataFrame:
    """``file_metrics`` rows from the feature table."""
    return (features.where(F.col("language").isNotNull() & (F.col("chars") > 0))
                    .select("repo", "path", "file_seq", "language", *METRICS))
