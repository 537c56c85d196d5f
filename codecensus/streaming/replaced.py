"""Running totals of files that land again.

A file that lands a second time replaces its earlier version. Keyed state
per (repo, path) holds the last version's line counts; a new version emits
the difference, which takes the old counts back. Each micro-batch adds its
differences to the totals of the batch before and writes them under its own
number, so a repeated batch writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codecensus import rules
from codecensus.functions import sql as S
from codecensus.functions.text import lines_of, safe_percentage
from codecensus.operators.classify import lookup
from codecensus.operators.metrics import metric_columns
from codecensus.streaming.incremental import CONTENTS_SCHEMA, _location

COUNTS = ["files", "lines", "code_lines", "comment_lines", "blank_lines"]
DIFFERENCE = "repo string, " + ", ".join(f"{c} long" for c in COUNTS)
VERSION = "landed long, file string, " + ", ".join(f"{c} long" for c in COUNTS)


def _versions(spark: SparkSession, source_dir: str) -> DataFrame:
    """Counts of each landed file with when and in which data file it landed;
    files without metrics count nothing."""
    texts = (spark.readStream.schema(CONTENTS_SCHEMA).parquet(source_dir)
             .select("repo", "path", "content", F.unix_micros("_metadata.file_modification_time").alias("landed"),
                     F.col("_metadata.file_path").alias("file"), lookup(rules.LANGUAGE_EXTENSIONS, S.suffix("path")).alias("language")))
    measured = F.col("language").isNotNull() & (F.length("content") > 0)
    lines = texts.withColumn("_measured", F.coalesce(measured, F.lit(False))).withColumn("_lines", lines_of(F.coalesce("content", F.lit(""))))
    counts = lines.select("repo", "path", "landed", "file", "_measured", *metric_columns(F.col("_lines"), F.col("language")))
    return counts.select("repo", "path", "landed", "file", F.col("_measured").cast("long").alias("files"),
                         *[F.when(F.col("_measured"), F.col(c)).otherwise(0).cast("long").alias(c) for c in COUNTS[1:]])


def _difference(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the newest version changes; older ones, also of batches before,
    change nothing."""
    last = state.get if state.exists else (-1, "", *[0] * len(COUNTS))
    newest = max((row for f in frames for row in f[["landed", "file", *COUNTS]].itertuples(index=False, name=None)), default=last)
    newest = tuple(x if isinstance(x, str) else int(x) for x in newest)
    if newest[:2] > tuple(last[:2]):
        state.update(newest)
        yield pd.DataFrame([(key[0], *(n - o for n, o in zip(newest[2:], last[2:], strict=True)))], columns=["repo", *COUNTS])


def stream_replaced_totals(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str | None = None,
                           available_now: bool = True) -> StreamingQuery:
    """Totals per repository of the newest version of each landed file, under
    ``sink_dir/batch=<id>`` after each micro-batch."""
    changes = _versions(spark, source_dir).groupBy("repo", "path").applyInPandasWithState(
        _difference, DIFFERENCE, VERSION, "append", GroupStateTimeout.NoTimeout)
    root = sink_dir.rstrip("/")

    def publish(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id:
            rows = rows.unionByName(batch.sparkSession.read.schema(DIFFERENCE).parquet(f"{root}/batch={batch_id - 1}"))
        totals = rows.groupBy("repo").agg(*[F.sum(c).alias(c) for c in COUNTS]).where("files <> 0")
        totals.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    w = (changes.writeStream.outputMode("append").foreachBatch(publish)
         .option("checkpointLocation", _location(spark, "replaced_totals", checkpoint)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def replaced_totals(spark: SparkSession, sink_dir: str) -> DataFrame:
    """``code_metrics_totals`` rows after the last finished micro-batch."""
    every = spark.read.parquet(sink_dir)
    last = every.agg(F.max("batch").alias("batch"))
    t = every.join(F.broadcast(last), "batch", "left_semi")  # one row
    named = t.select("repo", F.col("lines").alias("total_lines"), *COUNTS[2:], F.col("files").alias("files_analyzed"))
    return named.select("*", *[safe_percentage(f"{c}_lines", "total_lines").alias(f"{c}_pct") for c in ("code", "comment", "blank")])
