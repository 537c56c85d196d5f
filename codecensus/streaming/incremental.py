"""Structured Streaming drivers for newly landed ``contents`` files.

``stream_file_metrics`` appends per-file line metrics (map-only, so append
mode needs no state). ``stream_repo_metric_totals`` keeps running per-repo
sums in the streaming state store and rewrites the small per-repo result
after each micro-batch. Stream checkpoints live under the session's shared
``spark.checkpoint.dir`` unless a location is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codecensus.operators.metrics import file_metrics
from codecensus.session import shared_dir

CONTENTS_SCHEMA = "repo string, path string, file_seq bigint, content string"


def _location(spark: SparkSession, name: str, given: str | None) -> str:
    return given or f"{shared_dir(spark).rstrip('/')}/streams/{name}"


def contents_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CONTENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(source_dir)


def stream_file_metrics(spark: SparkSession, source_dir: str, sink_dir: str,
                        checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append per-file metrics of every new content file to ``sink_dir`` (parquet)."""
    fm = file_metrics(contents_stream(spark, source_dir))
    w = (fm.writeStream.format("parquet").outputMode("append")
           .option("path", sink_dir).option("checkpointLocation", _location(spark, "file_metrics", checkpoint)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def stream_repo_metric_totals(spark: SparkSession, source_dir: str, sink_dir: str,
                              checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Running per-repo totals of the line classes; each micro-batch writes
    its (one row per repository) result to ``sink_dir/batch=<id>``, which a
    repeated batch writes again. ``latest_totals`` reads the last one."""
    fm = file_metrics(contents_stream(spark, source_dir))
    totals = fm.groupBy("repo").agg(
        F.sum("lines").alias("total_lines"), F.sum("code_lines").alias("code_lines"),
        F.sum("comment_lines").alias("comment_lines"), F.sum("blank_lines").alias("blank_lines"),
        F.count(F.lit(1)).alias("files_analyzed"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={batch_id}")

    w = (totals.writeStream.outputMode("complete").foreachBatch(publish)
               .option("checkpointLocation", _location(spark, "repo_metric_totals", checkpoint)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def latest_totals(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The totals after the last finished micro-batch."""
    every = spark.read.parquet(sink_dir)
    last = every.agg(F.max("batch").alias("batch"))
    return every.join(F.broadcast(last), "batch", "left_semi").drop("batch")  # one row
