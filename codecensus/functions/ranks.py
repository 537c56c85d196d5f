"""Gapless ranks of large groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES, COARSE = 256, 16
#: rows of the sample for each lane
SAMPLED = 4


def splitters(df: DataFrame, by: list[str], key: Column, lanes: int = LANES) -> DataFrame:
    """(by, _cuts): for each group at most ``lanes - 1`` keys that cut its
    rows into lanes of about the same size.

    The sample is that of the smallest key hashes, a fixed number a group, so
    it is the same in every run and a window group limit takes it. A group
    with fewer rows than the sample has no cuts: it is one lane.
    """
    size = lanes * SAMPLED
    hashed = df.select(*by, key.alias("_key")).withColumn("_hash", F.xxhash64("_key"))
    first = (hashed.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_hash", "_key")))
             .where(F.col("_n") <= size))
    sample = first.groupBy(*by).agg(F.array_sort(F.collect_list("_key")).alias("_sample")).where(F.size("_sample") >= size)
    cuts = F.transform(F.sequence(F.lit(SAMPLED), F.lit(size - SAMPLED), F.lit(SAMPLED)), lambda i: F.col("_sample")[i])
    return sample.select(*by, cuts.alias("_cuts"))


def lane_of(cuts: Column, key: Column) -> Column:
    """Number of cuts up to the key: first among every COARSE-th, then inside
    that stretch. Rows of groups without cuts are in lane 0."""
    every = F.filter(cuts, lambda _, i: (i + 1) % COARSE == 0)
    block = COARSE * F.size(F.filter(every, lambda c: c <= key))
    inside = F.size(F.filter(F.slice(cuts, block + 1, COARSE - 1), lambda c: c <= key))
    return F.when(cuts.isNull(), F.lit(0)).otherwise(block + inside)


def gapless_rank(df: DataFrame, by: list[str], key: Column, rank: str = "rank", count: str | None = None,
                 lanes: int = LANES) -> DataFrame:
    """Adds the rank (from 1) of each row in its ``by`` group, by ``key``
    ascending (a struct for an order of several columns, nulls first).

    Rows are numbered inside lanes of about equal size, whatever the keys
    look like, and the lanes' row counts, summed up in lane order, are added.
    Only the counts of a group's lanes come together. ``count`` names a
    column for the number of rows of the group.
    """
    keyed = df.withColumn("_rank_key", key)
    cuts = splitters(df, by, key, lanes)
    laned = keyed.join(cuts, by, "left").withColumn("_lane", lane_of(F.col("_cuts"), F.col("_rank_key"))).drop("_cuts")
    size = laned.groupBy(*by, "_lane").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)
    before = size.select(*by, F.col("_lane"),
                         (F.sum("_n").over(whole.orderBy("_lane")) - F.col("_n")).alias("_before"),
                         F.sum("_n").over(whole).alias("_all"))
    inside = F.row_number().over(Window.partitionBy(*by, "_lane").orderBy("_rank_key"))
    out = laned.withColumn("_inside", inside).join(before, [*by, "_lane"])
    out = out.withColumn(rank, (F.col("_before") + F.col("_inside")).cast("bigint"))
    if count:
        out = out.withColumn(count, F.col("_all"))
    return out.drop("_lane", "_inside", "_before", "_all", "_rank_key")
