"""Connected components by hooking and pointer jumping, with written tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp) for every id of the edges (a, b); comp is the smallest id that links reach.

    Each round, a component hooks onto its smallest smaller neighbour, pointers are jumped to their roots and the
    edges are contracted, so that rounds grow with the logarithm of the ids. Minima combine before the shuffle and
    joins have one row for each id on one side, so a hub costs no task more than adaptive skew joins split.
    """
    live = scratch.cut(edges.where("a <> b").select("a", "b").distinct())
    comp = scratch.cut(live.select(F.col("a").alias("id")).union(live.select("b")).distinct().withColumn("comp", F.col("id")))
    while True:
        both = live.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("to"))
        parent = scratch.cut(both.groupBy("id").agg(F.min("to").alias("to")))
        if parent.isEmpty():
            return comp
        while True:
            up = parent.select(F.col("id").alias("to"), F.col("to").alias("far"))
            jumped = scratch.cut(parent.join(up, "to", "left").select("id", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            scratch.drop(parent)
            parent = jumped
            if not moved:
                break
        root = parent.select(F.col("id").alias("comp"), F.col("to").alias("root"))
        new_comp = scratch.cut(comp.join(root, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))
        ra, rb = (parent.select(F.col("id").alias(x), F.col("to").alias("r" + x)) for x in "ab")
        new_live = live.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        new_live = scratch.cut(new_live.where("a <> b").distinct())
        scratch.drop(comp, live, parent)
        comp, live = new_comp, new_live
