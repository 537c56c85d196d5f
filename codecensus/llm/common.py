"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and
    executors share. Where it is unset (local tests) a folder is set; on a
    cluster an unset folder is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
        d = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back:
    the lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before per-row work that is heavy on CPU."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def body(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grams(flat: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of consecutive values inside each list.

    Returns hash, list index and start within the list, in order. A list
    that is shorter than ``n`` but not empty gives one gram of all it has.
    """
    flat = flat.astype(np.uint64, copy=False)
    lens = np.diff(offsets)
    counts = np.where(lens >= n, lens - n + 1, (lens > 0).astype(lens.dtype))
    owner = np.repeat(np.arange(len(lens)), counts)
    first = np.cumsum(counts) - counts
    start = np.arange(counts.sum()) - first[owner]
    at = offsets[:-1][owner] + start
    h = np.zeros(len(at), np.uint64)
    have = lens[owner]
    for k in range(n):
        inside = k < have
        v = flat[np.where(inside, at + k, 0)] if len(flat) else h
        h = np.where(inside, mix(h * np.uint64(0x9E3779B97F4A7C15) + v), h)
    return h, owner, start


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]] if len(offsets) else np.zeros(0)
    return flat, offsets - offsets[0]


def as_list(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
