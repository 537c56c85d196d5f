"""Session helpers: sane defaults for the operators, the shared folder, and
tables of intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "codecensus",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return a session with AQE and skew handling on.

    On a cluster the master and partition counts come from the submit
    configuration; the arguments only fill in what is unset (tests, bench).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode runs everything in the driver JVM; only applies when
            # this call starts the JVM
            b = b.config("spark.driver.memory", "8g")
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.ui.enabled", "false")
          # text columns are wide: keep input splits moderate so a task's
          # rows fit comfortably in memory at any scale
          .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024)))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. On a cluster it
    must be set; a local session without one (tests, bench) gets a folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder there")
        d = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it
    back. This runs a job: callers decide when an intermediate result is
    worth it; plan builders never call it."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)
