"""Exact top-N values without shuffling the rare ones.

Each task counts its own values and notes its own top N. Three rounds follow,
over these partial counts:

1. the tasks' top values are summed: the N-th largest sum of a group is a
   threshold that its N-th most frequent value reaches at least;
2. a value that reaches the threshold has, in some task, at least the
   threshold divided by the number of tasks that hold the group: only such
   values are candidates;
3. the candidates' partial counts are summed and ranked.

A value below its share in every task is counted where it stands and never
moves. Ties rank by first appearance, as everywhere.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: distinct values that a task holds; more become a further part
HELD = 1_000_000
PARTIAL = "part string, {by}, value string, n long, file_seq long, pos int, place int"


def partial_counts(items: DataFrame, by: list[str], n: int, held: int = HELD) -> DataFrame:
    """(part, by, value, n, file_seq, pos, place) of the string values of
    ``items``: counts and first appearances within a part, and the value's
    place among those of its group there. Nothing is shuffled."""
    schema = PARTIAL.format(by=", ".join(f"{c} string" for c in by))
    names = [x.split()[0] for x in schema.split(", ")]
    order = [("n", "descending"), ("file_seq", "ascending"), ("pos", "ascending")]

    def summed(table: pa.Table) -> pa.Table:
        """Rows of the same value put together; the first one by place."""
        table = table.sort_by([("file_seq", "ascending"), ("pos", "ascending")])
        out = table.group_by([*by, "value"], use_threads=False).aggregate([("n", "sum"), ("file_seq", "first"), ("pos", "first")])
        return out.rename_columns({"n_sum": "n", "file_seq_first": "file_seq", "pos_first": "pos"}).select([*by, "value", "n", "file_seq", "pos"])

    def sent(table: pa.Table):
        part, table = uuid.uuid4().hex, table.sort_by([(c, "ascending") for c in by] + order)
        place, last, k = [], None, 0
        for key in zip(*(table.column(c).to_pylist() for c in by), strict=True):
            k = k + 1 if key == last else 1
            last = key
            place.append(min(k, n + 1))
        columns = [pa.array([part] * table.num_rows, pa.string()), *(table.column(c).combine_chunks() for c in [*by, "value", "n", "file_seq", "pos"]),
                   pa.array(place, pa.int32())]
        yield from pa.table([c.cast(t) for c, t in zip(columns, kinds, strict=True)], names=names).to_batches(max_chunksize=50_000)

    kinds = [pa.string()] * (1 + len(by)) + [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        own = None
        for batch in batches:
            table = summed(pa.Table.from_batches([batch]))
            own = table if own is None else summed(pa.concat_tables([own, table]))
            if own.num_rows > held:
                yield from sent(own)
                own = None
        if own is not None and own.num_rows:
            yield from sent(own)

    rows = items.where(F.col("value").isNotNull()).select(
        *by, "value", F.lit(1).cast("long").alias("n"), F.col("file_seq").cast("long").alias("file_seq"), F.col("pos").cast("int").alias("pos"))
    return rows.mapInArrow(run, schema)


def candidates(partial: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, value) that may be among the top ``n`` of their group; all that are."""
    lower = partial.where(F.col("place") <= n).groupBy(*by, "value").agg(F.sum("n").alias("least"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("least"), "value"))
    threshold = lower.withColumn("k", nth).where(F.col("k") <= n).groupBy(*by).agg(
        F.when(F.count(F.lit(1)) == n, F.min("least")).otherwise(F.lit(0)).alias("threshold"))  # fewer than n: all values
    # one row a part and group says where the group is
    spread = partial.where("place = 1").groupBy(*by).agg(F.count(F.lit(1)).alias("parts"))
    limits = threshold.join(spread, by)
    return partial.join(limits, by).where(F.col("n") * F.col("parts") >= F.col("threshold")).select(*by, "value").distinct()


def top_values(partial: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, rank, value, occurrences): the ``n`` most frequent values of each
    group, ties by first appearance. ``partial`` is best a written table."""
    chosen = partial.join(candidates(partial, by, n), [*by, "value"], "left_semi")
    total = chosen.groupBy(*by, "value").agg(F.sum("n").alias("occurrences"), F.min(F.struct("file_seq", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("occurrences"), "first"))
    return total.withColumn("rank", rank).where(F.col("rank") <= n).select(*by, "rank", "value", "occurrences")
