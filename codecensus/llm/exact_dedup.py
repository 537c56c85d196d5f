"""Exact dedup over an extendible-hash index (DataFrame functions only).

A directory maps the leading bits of a text's hash to a bucket. It starts
with one bucket; as long as a bucket holds more keys than its capacity, the
directory doubles (one more bit) and the overfull buckets split. A capacity
of ``CAPACITY`` keys fills the directory's cells at some 134 million keys;
beyond, the capacity grows with the keys, so that buckets still split evenly.
The index has one row per distinct text: bucket, hash, place in the hash's
collision chain, digest and the row that stays. It is a table on the shared
folder, written by owner tasks that each hold a range of buckets. Texts are
compared byte for byte when the entries are built: the grouping key is the
text. A row is looked up by its bucket, which the directory names, then by
its hash, then along the chain.

Defined cases: a null text is an empty text and all empty texts are equal; a
null ``doc_id`` never stays unless its whole group has none (then
``keep_id`` is null and nothing is kept); repeated rows each give a row, with
the same flags; texts of any length are hashed and compared whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codecensus.llm.common import body, read, stored

CELL_BITS = 16  # the directory has at most 2**16 cells, which bounds its broadcast
CAPACITY = 4096  # keys of a bucket


def _hash(text: Column, hash_bits: int) -> Column:
    """``hash_bits`` under 64 keeps only leading bits (tests of collisions)."""
    h = F.xxhash64(text)
    return h if hash_bits == 64 else F.shiftleft(F.shiftright(h, 64 - hash_bits), 64 - hash_bits)


def _cell(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - CELL_BITS).cast("int")


def build_directory(keys: DataFrame, capacity: int) -> DataFrame:
    """Rows (cell, bucket, depth), at most 2**CELL_BITS of them.

    ``keys`` has one row per distinct hash ``h``. ``bucket`` is the first
    cell of the bucket's key range, ``depth`` its number of leading bits. A
    doubling splits each bucket in two; a cell's bucket is that of the first
    doubling at which it is not overfull. The loads of all doublings come
    from the cells' key counts in one pass, whose size is that of the
    directory.
    """
    cells = keys.groupBy(_cell(F.col("h")).alias("cell")).agg(F.count(F.lit(1)).alias("keys"))
    doubled = (cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(CELL_BITS))))
               .withColumn("bucket", F.expr(f"shiftleft(shiftright(cell, {CELL_BITS} - depth), {CELL_BITS} - depth)")))
    load = doubled.groupBy("depth", "bucket").agg(F.sum("keys").alias("load"))
    fits = load.filter((F.col("load") <= capacity) | (F.col("depth") == CELL_BITS)).select("depth", "bucket")
    # at most 2**(CELL_BITS + 1) rows of two numbers
    first = doubled.join(F.broadcast(fits), ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("of"))
    return first.select("cell", "of.bucket", "of.depth")


def build_index(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The directory (cell, bucket, depth) and the index table: bucket,
    depth, h, chain, sha, keep_id, group_size."""
    text = docs.select("doc_id", body().alias("text")).withColumn("h", _hash(F.col("text"), hash_bits))
    keys = stored(text.select("h").distinct(), "keys")
    directory = stored(build_directory(keys, max(capacity, -(-keys.count() >> CELL_BITS - 1))), "directory")
    entries = (text.withColumn("cell", _cell(F.col("h"))).join(F.broadcast(directory), "cell")
               .groupBy("bucket", "depth", "h", "text")
               .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
               .select("bucket", "depth", "h", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"))
    chain = F.row_number().over(W.partitionBy("bucket", "h").orderBy("sha"))
    owned = entries.repartitionByRange("bucket", "h").withColumn("chain", chain)
    return directory, stored(owned.sortWithinPartitions("bucket", "h", "chain"), "index")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """Every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest ``doc_id`` stays. A row finds its
    bucket in the directory, and its entry there by hash and, along the chain,
    by digest; both sides of that join are narrow, and the planner splits a
    hash that very many rows share.
    """
    directory, index = build_index(docs, capacity, hash_bits)
    probe = docs.select("doc_id", _hash(body(), hash_bits).alias("h"), F.sha2(body(), 256).alias("sha"))
    # at most 2**CELL_BITS rows
    placed = probe.withColumn("cell", _cell(F.col("h"))).join(F.broadcast(directory.select("cell", "bucket")), "cell").drop("cell")
    return placed.join(index.select("bucket", "h", "sha", "keep_id", "group_size"), ["bucket", "h", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
