"""Balanced label propagation into shards (DataFrame functions only).

Documents with equal texts are linked. Every document starts in the shard
its id's hash names; then, round by round, linked documents move to the shards
that hold most of their group, as far as the quota of those shards goes: the
smallest parts of a group go first, and a part is split where the room is less.
Every move joins a part to one that is no smaller, so the rounds come to an
end; they go on until one moves nothing. Members of a group are
interchangeable, so the rounds run on (group, shard) counts, joined with the
shards' loads, and not on single rows. Documents without links fill the rest,
so that no two shards' counts differ by more than one.

Defined cases: a null text has no bytes (size 8) and all empty texts are
linked; a null ``doc_id`` is placed like any other row; repeated rows are
linked and get places of their own; texts of any length count whole; ties
are ordered by group and shard, rows by id and size, and equal rows are
interchangeable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codecensus.llm.common import body, read, stored

GAINS, LANES = 48, 64  # classes of group size, and lanes within a class: bounds the quota table


def _propose(state: DataFrame, load: DataFrame) -> DataFrame:
    """Moves (g, label, target, n): a group's parts stand in order of size; the
    room of the first ones is filled from the last ones."""
    order = [F.desc("c"), F.desc("room"), "label"]
    room = F.greatest("free", F.lit(0)).alias("room")
    own = (state.join(F.broadcast(load.select("label", room)), "label")
           .withColumn("parts", F.count(F.lit(1)).over(W.partitionBy("g"))).filter("parts > 1"))
    own = own.select("g", "label", "c", "room", F.row_number().over(W.partitionBy("g").orderBy(*order)).alias("at"),
                     F.sum("room").over(W.partitionBy("g").orderBy(*order)).alias("filled"),
                     (F.sum("c").over(W.partitionBy("g")) - F.sum("c").over(W.partitionBy("g").orderBy(*order))).alias("behind"))
    sinks = own.filter("room > 0").select("g", F.col("label").alias("target"), F.col("at").alias("ahead"), "filled", "room")
    n = F.least("filled", F.col("behind") + F.col("c")) - F.greatest(F.col("filled") - F.col("room"), "behind")
    return (own.select("g", "label", "at", "c", "behind").join(sinks, "g").filter(F.col("ahead") < F.col("at"))
            .select("g", "label", "target", n.alias("n")).filter("n > 0"))


def _admit(moves: DataFrame, load: DataFrame) -> DataFrame:
    """Let moves into each shard, largest first, while its room lasts; the last
    one is split. The running sums are over (shard, size class, lane), a bounded
    table, and over the moves of the one cell where the room ends."""
    cls = F.least(F.lit(GAINS - 1), F.floor(F.log2(F.col("n")))).cast("int")
    cell = moves.withColumn("cls", cls).withColumn("lane", F.pmod(F.xxhash64("g", "label"), F.lit(LANES)).cast("int"))
    asked = cell.groupBy("target", "cls", "lane").agg(F.sum("n").alias("asked"))
    upto = F.sum("asked").over(W.partitionBy("target").orderBy(F.desc("cls"), "lane"))
    left = F.col("free") - (F.col("upto") - F.col("asked"))
    cells = (asked.withColumn("upto", upto).join(F.broadcast(load), F.col("target") == F.col("label"))
             .select("target", "cls", "lane", "asked", left.alias("left")).filter("left > 0"))
    met = cell.join(F.broadcast(cells), ["target", "cls", "lane"])
    last = met.filter("asked > left").withColumn("to", F.sum("n").over(
        W.partitionBy("target").orderBy(F.desc("n"), "g", "label").rowsBetween(W.unboundedPreceding, 0)))
    split = F.least("n", F.col("left") - (F.col("to") - F.col("n"))).alias("n")
    return met.filter("asked <= left").select("g", "label", "target", "n").unionByName(
        last.select("g", "label", "target", split).filter("n > 0"))


def _settle(state: DataFrame, quota: DataFrame) -> DataFrame:
    """(g, label, c) after rounds of moves, up to the one that moves nothing."""
    while True:
        load = quota.join(state.groupBy("label").agg(F.sum("c").alias("load")), "label", "left").select(
            "label", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("free"))
        moved = stored(_admit(_propose(state, load), load), "shard-moves")
        if moved.isEmpty():
            return state
        state = stored(state.unionByName(moved.select("g", "label", (-F.col("n")).alias("c")))
                       .unionByName(moved.select("g", F.col("target").alias("label"), F.col("n").alias("c")))
                       .groupBy("g", "label").agg(F.sum("c").alias("c")).filter("c > 0"), "shard-state")


def _cuts(start: DataFrame, state: DataFrame) -> DataFrame:
    """(g, label0, since, to, label): the places of a group's rows, counted
    inside each first shard, that go to each shard."""
    ends = lambda by: F.sum("c").over(W.partitionBy("g").orderBy(by))
    first = start.select("g", F.col("label").alias("label0"), F.col("c").alias("c0"), ends("label").alias("to0"))
    last = state.select("g", "label", "c", ends("label").alias("to1"))
    begin = F.col("to0") - F.col("c0")
    return (first.join(last, "g").select(
        "g", "label0", (F.greatest(begin, F.col("to1") - F.col("c")) - begin).alias("since"),
        (F.least("to0", "to1") - begin).alias("to"), "label").filter("since < to"))


def _shards(spark, shards: int, rows: int) -> DataFrame:
    """(label, quota): counts at most one apart."""
    return spark.range(shards).select(F.col("id").cast("int").alias("label"),
                                      (F.lit(rows // shards) + (F.col("id") < rows % shards).cast("long")).alias("quota"))


def _ranked(df: DataFrame, by: list[str], lanes: int, out: str) -> DataFrame:
    """Gapless rank from 0 of the rows of each ``by`` group, in two steps: a
    running sum over the group's lanes, and a row number inside each lane, so
    that no task holds a whole group."""
    lane = [F.pmod(F.xxhash64("g"), F.lit(LANES)).cast("int").alias("_lane"),
            F.pmod(F.xxhash64("doc_id", "crc"), F.lit(lanes)).cast("int").alias("_sub")]
    df = df.select("*", *lane)
    key = [*by, "single", "_lane", "_sub"]
    before = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_to", F.sum("_n").over(W.partitionBy(*by).orderBy("single", "_lane", "_sub")))
              .select(*key, (F.col("_to") - F.col("_n")).alias("_before")))
    inside = F.row_number().over(W.partitionBy(*key).orderBy("doc_id", "size")) - 1
    return (df.withColumn("_in", inside).join(before, key)
            .withColumn(out, F.col("_before") + F.col("_in")).drop("_lane", "_sub", "_in", "_before"))


def balanced_shards(docs: DataFrame, shards: int = 24, lane_rows: int = 1_000_000) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, shard, slot (gapless from 0
    in each shard). ``lane_rows``: rows that one ranking lane should hold."""
    spark = docs.sparkSession
    text = body()
    rows = stored(docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                              F.crc32(text).alias("crc"), F.xxhash64(text, F.octet_length(text)).alias("g"))
                  .withColumn("label0", F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int")), "shard-rows")
    total = rows.count()
    quota = _shards(spark, shards, total)
    linked = rows.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("g")
    start = stored(rows.groupBy("g", F.col("label0").alias("label")).agg(F.count(F.lit(1)).alias("c"))
                   .join(linked, "g", "left_semi"), "shard-state")
    cuts = _cuts(start, _settle(start, quota))
    lanes = max(16, -(-total // (lane_rows * LANES)))
    chunks = start.select("g", F.col("label").alias("label0"))  # a hot group's rows don't meet in one task
    members = _ranked(rows.join(chunks, ["g", "label0"], "left_semi").withColumn("single", F.lit(False)), ["g", "label0"], lanes, "at")
    members = members.join(cuts, ["g", "label0"]).filter((F.col("at") >= F.col("since")) & (F.col("at") < F.col("to")))
    alone = rows.join(chunks, ["g", "label0"], "left_anti").withColumn("single", F.lit(True)).withColumn("label", F.col("label0"))
    kept = ["g", "label0", "doc_id", "size", "crc", "label", "single"]
    placed = members.select(*kept).unionByName(alone.select(*kept))
    ranked = stored(_ranked(placed, ["label"], lanes, "rank").join(F.broadcast(quota), "label"), "shard-ranked")
    stay = ranked.filter(F.col("rank") < F.col("quota")).select(
        "doc_id", "size", "crc", F.col("label").alias("shard"), F.col("rank").alias("slot"))
    over = _ranked(ranked.filter(F.col("rank") >= F.col("quota")).drop("rank", "quota").withColumn("all", F.lit(0)),
                   ["all"], lanes, "rank")
    had = quota.join(ranked.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").select(
        F.col("label").alias("shard"), F.least("quota", F.coalesce("n", F.lit(0))).alias("had"), "quota")
    room = had.withColumn("to", F.sum(F.col("quota") - F.col("had")).over(W.orderBy("shard"))).withColumn(
        "since", F.col("to") - (F.col("quota") - F.col("had")))
    moved = over.join(F.broadcast(room), (F.col("rank") >= F.col("since")) & (F.col("rank") < F.col("to"))).select(
        "doc_id", "size", "crc", "shard", (F.col("had") + F.col("rank") - F.col("since")).alias("slot"))
    return stay.unionByName(moved).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    placed = balanced_shards(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
