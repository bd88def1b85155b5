"""Connected components of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id of the pairs (a, b): the smallest id that pairs lead to.

    Stars that shrink: each round, every id's larger neighbours are joined to its smallest, then its other neighbours; rounds grow with
    the logarithm of the longest path. Each round is written, so that lost executors cost one round at most.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: neighbours above an id point to the smallest neighbour, or to the id
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: an id and its smaller neighbours point to the smallest of them
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = cut(small)
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            return new.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(new.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        e = new
