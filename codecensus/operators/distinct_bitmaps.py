"""Exact distinct counts that merge.

Values get dense numbers from a dictionary, and a set of values is a bitmap
over these numbers. Bitmaps are made once for a day (or any batch), stored,
and merged by OR: the distinct count over any choice of days is read from
the bitmaps without seeing the values again. A dictionary only grows, so
stored bitmaps stay right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus.functions.ranks import gapless_rank


def grown_dictionary(values: DataFrame, by: list[str], value: str = "value", known: DataFrame | None = None) -> DataFrame:
    """(by, value, id): ``known`` and, numbered behind it, the new values of
    each group. Numbers of a group start at 1 and have no gaps."""
    new = values.select(*by, value).where(F.col(value).isNotNull()).distinct()
    if known is None:
        return gapless_rank(new, by, F.col(value), rank="id").select(*by, value, "id")
    last = known.groupBy(*by).agg(F.max("id").alias("last"))
    fresh = gapless_rank(new.join(known.select(*by, value), [*by, value], "left_anti"), by, F.col(value), rank="id")
    numbered = fresh.join(last, by, "left").select(*by, value, (F.col("id") + F.coalesce("last", F.lit(0))).alias("id"))
    return known.select(*by, value, "id").unionByName(numbered)


def value_bitmaps(values: DataFrame, dictionary: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, bucket, bitmap): the values of each group as bitmaps of 32,768
    numbers each; duplicates meet in a partial aggregation."""
    numbered = values.select(*by, value).join(dictionary, [*by, value])
    return (numbered.groupBy(*by, F.bitmap_bucket_number("id").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap")))


def distinct_counts(bitmaps: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): distinct values over all given bitmaps, which may be those of
    many days."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))
