"""Rows of a wide table by the keys of a narrow one, without moving the rest.

The keys are hashed into a bitmap of fixed size that every task holds; rows
whose bit is not set cannot match and stay where they are. What is left (the
matches and a few false hits) is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # a megabyte; the share of false hits is keys / BITS


def _number(on: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(bits)) + 1


def may_match(rows: DataFrame, keys: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` whose ``on`` columns may be among those of ``keys``."""
    marks = keys.select(_number(on, bits).alias("_n")).groupBy(F.bitmap_bucket_number("_n").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("_bits"))
    numbered = rows.withColumn("_n", _number(on, bits)).withColumn("_bucket", F.bitmap_bucket_number("_n"))
    at = F.bitmap_bit_position("_n")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("_byte & shiftleft(1, CAST(_at % 8 AS INT))") != 0
    # at most bits / 32768 rows of 4 KB
    met = numbered.join(F.broadcast(marks), "_bucket").withColumns({"_byte": byte, "_at": at})
    return met.where(hit).drop("_n", "_bucket", "_bits", "_byte", "_at")


def matching(rows: DataFrame, keys: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """The rows whose ``on`` columns are among those of ``keys``; only rows
    that may match are moved. An inner join with distinct keys, since Spark
    would push a semi join below the test of the bits."""
    return may_match(rows, keys, on, bits).join(keys.select(*on).distinct(), on).select(*rows.columns)
