"""Connected components by joins: labels shrink to the smallest neighbour's
label and then jump along it, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); ``label`` is the
    smallest node that can be reached.

    Each node points to its smallest smaller neighbour; its other smaller
    neighbours are linked to that one instead. Such links are the same for
    very many nodes of a large group, so only few are left, and the nodes
    that nobody points to take no part in the rounds: they read their
    pointer's label at the end.
    """
    down = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    pointer = stored(down.groupBy("a").agg(F.min("b").alias("to")), "pointers")
    targets = down.select(F.col("b").alias("node")).distinct()
    others = down.join(pointer, "a").filter("b <> to").select(F.col("b").alias("a"), F.col("to").alias("b"))
    own = pointer.join(targets, F.col("a") == F.col("node"), "left_semi").select("a", F.col("to").alias("b"))
    labels = stored(_rounds(others.unionByName(own).distinct()), "core")
    found = pointer.unionByName(targets.join(pointer, F.col("node") == F.col("a"), "left_anti").select(
        F.col("node").alias("a"), F.col("node").alias("to")))
    return (found.join(labels, F.col("to") == F.col("node"), "left")
            .select(F.col("a").alias("node"), F.coalesce("label", "to").alias("label")))


def _rounds(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of the edges. Hot nodes only ever meet as
    partial minima."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "core-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", "label", F.least("label", "near").alias("low"))
        target = lower.select(F.col("node").alias("t"), F.col("low").alias("jump"))
        moved = stored(lower.join(target, F.col("low") == F.col("t"), "left").select(
            "node", F.least("low", "jump").alias("label"), (F.least("low", "jump") < F.col("label")).alias("moved")),
            "labels")
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels
