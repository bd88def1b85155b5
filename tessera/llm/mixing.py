"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Sources share ``share`` times all words by weight; a source stops at ``max_epochs`` times its own words and what it
cannot take is shared again by weight among the others until none is above its cap. That end state is computed in
closed form: in rising order of cap to weight, the first sources are full and all others get one common level.

A source's target is reached by repeating all its documents the whole number of times that fits, and a seeded
selection of them once more: documents in the order of a seeded hash, as long as the remaining words last; the last one is taken in part,
so that a source's words differ from its target by less than one word. The hash where the selection ends is found in
a histogram over hash ranges, and only the one range of each source that holds the end is put in order row by row.

Everything is DataFrame operations. Words are runs of characters other than 0x20 and 0x09-0x0D. Rows: null texts have
size 0 and take nothing; null sources are one source, the last; a source without words has target 0; equal rows
(doc_id, source and text) are numbered and taken one after another; an empty table gives an empty one. Columns named like the output
are replaced, others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch, free_name, replace_columns, sized

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Hash ranges of a source: a row-wise order is needed in one of them only.
RANGE_BITS = 12
SALTS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(seed: int) -> Column:
    """63 seeded bits of a row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "text"), 1)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Sources by code point, null last, get the weights in turn.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumns({"full": F.coalesce(F.sum("cap").over(order), F.lit(0.0)), "used": F.coalesce(F.sum("w").over(order), F.lit(0.0))})
    s = s.withColumns({"all_w": F.sum("w").over(every), "budget": F.sum("source_size").over(every) * F.lit(float(share))})
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / (F.col("all_w") - F.col("used")))
    # the level that holds is that of the first source in the order that is not full
    s = s.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w"))).alias("target"))


def _with_sources(rows: DataFrame, source: str, key: str, per_source: DataFrame, count: int, name: str) -> DataFrame:
    """Rows with a struct ``name`` of their source's columns: sent to all executors when few, else joined with every source's rows dealt over salts."""
    at, deal = free_name(rows, "_source"), free_name(rows, "_salt")
    src = per_source.select(F.col("source").alias(at), F.struct(*[c for c in per_source.columns if c != "source"]).alias(name))
    if count <= 10_000:
        return rows.join(sized(src, count), F.col(source).eqNullSafe(F.col(at)), "left").drop(at)
    src = src.withColumn(deal + "s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn(deal, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return dealt.join(src, (F.col(deal) == F.col(deal + "s")) & F.col(source).eqNullSafe(F.col(at)), "left").drop(at, deal, deal + "s")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 31) -> DataFrame:
    """The documents with size, source_size, target, whole (complete repetitions) and taken (words of all repetitions)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    keyed = docs.select("doc_id", "source", "text")
    small = scratch.cut(keyed.select("source", _hash(seed).alias("h"), word_count(F.col("text")).alias("size")))
    ranges = small.groupBy("source", F.shiftright("h", 63 - RANGE_BITS).alias("range")).agg(F.sum("size").alias("words"))
    ranges = scratch.cut(ranges)
    goal = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.least(F.floor(epochs + F.lit(1e-12)), F.lit(int(max_epochs))).cast("long"))
    goal = scratch.cut(goal.withColumn("rest", F.greatest(F.round(F.col("target") - F.col("whole") * F.col("source_size")), F.lit(0.0)).cast("long")))
    sources = goal.count()

    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = _with_sources(ranges.withColumn("before", before), "source", "range", goal.select("source", "rest"), sources, "s")
    end = scratch.cut(ends.where("before <= s.rest and s.rest < before + words").select("source", "range", (F.col("s.rest") - F.col("before")).alias("left")))
    inside = _with_sources(small, "source", "h", end, sources, "s").where(F.shiftright("h", 63 - RANGE_BITS) == F.col("s.range"))
    inside = inside.groupBy("source", "h", F.col("s.left").alias("left")).agg(F.sum("size").alias("words"), F.max("size").alias("one"), F.count(F.lit(1)).alias("copies"))
    running = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = inside.withColumn("before", running).where("before <= left and left < before + words")
    last = last.select("source", F.col("h").alias("end_h"), (F.col("left") - F.col("before")).alias("part"), "one", "copies")
    plan = scratch.cut(_null_safe_left(goal, last))

    h, size, own, at = (free_name(docs, x) for x in ("_hash", "_words", "_plan", "_at"))
    rows = _with_sources(docs.withColumn(h, _hash(seed)).withColumn(size, word_count(F.col("text"))), "source", "doc_id", plan, sources, own)
    of = lambda name: F.col(f"{own}.{name}")
    ends_here = F.coalesce(F.col(h) == of("end_h"), F.lit(False)) & (of("rest") > 0)
    if plan.where("copies > 1 and rest > 0").isEmpty():
        numbered = rows.withColumn(at, F.lit(0).cast("long"))
    else:
        alike = _numbered(rows.where(ends_here & (of("copies") > 1)), h, at, scratch)
        numbered = rows.where(~ends_here | (of("copies") <= 1)).withColumn(at, F.lit(0).cast("long")).unionByName(alike)
    # equal rows take whole ones in turn, until the words that are left do not fill one
    part = F.least(F.greatest(of("part") - F.col(at) * of("one"), F.lit(0)), F.col(size))
    once_more = F.when(of("rest") <= 0, F.lit(0)).when(of("end_h").isNull() | (F.col(h) < of("end_h")), F.col(size)).when(ends_here, part).otherwise(F.lit(0))
    taken = (of("whole") * F.col(size) + once_more).cast("long")
    return replace_columns(numbered, {"size": F.col(size), "source_size": of("source_size"), "target": of("target"), "whole": of("whole"), "taken": taken}).drop(h, size, own, at)


def _numbered(rows: DataFrame, h: str, at: str, scratch: Scratch) -> DataFrame:
    """Rows with their number among those of the same hash.

    Their numbers within partitions are written first, so that a lost executor changes none, and only the partitions' counts
    are summed in order: a group of any size is never one task's.
    """
    place, part, key = (free_name(rows, x) for x in ("_place", "_part", "_key"))
    placed = rows.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33).cast("int"))
    placed = scratch.cut(placed)
    counts = placed.groupBy(F.col(h).alias(key), part).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn(at, before).withColumnRenamed(part, part + "s").drop("n")
    joined = placed.join(counts, (F.col(h) == F.col(key)) & (F.col(part) == F.col(part + "s")))
    order = W.partitionBy(h, part).orderBy(place)
    return joined.withColumn(at, F.col(at) + F.row_number().over(order) - 1).select(*rows.columns, at)


def _null_safe_left(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for each source on both sides."""
    b = b.withColumnRenamed("source", "_b")
    return a.join(b, a["source"].eqNullSafe(b["_b"]), "left").drop("_b")


def repeat(mixed: DataFrame) -> DataFrame:
    """One row for each repetition, with its number and words: whole ones, then the part of one that is left."""
    part = F.col("taken") - F.col("whole") * F.col("size")
    n = F.when(F.col("size") > 0, F.col("whole") + F.when(part > 0, 1).otherwise(0)).otherwise(0)
    number = free_name(mixed, "_number")
    rows = mixed.where(n > 0).withColumn(number, F.explode(F.sequence(F.lit(1), n.cast("int"))))
    words = F.when(F.col(number) <= F.col("whole"), F.col("size")).otherwise(part)
    return replace_columns(rows, {"repetition": F.col(number), "words": words}).drop(number)
