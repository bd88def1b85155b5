"""A Merkle manifest of a dataset, built of higher-order functions over fixed-size blocks.

A row's leaf is a digest of its columns. Within a group, leaves stand in the order of their key; every run of ``FAN`` consecutive
nodes becomes its digest, level by level, until one node is left: the group's subroot. Subroots, in the order of their groups, give the
root likewise. A block is an array of ``FAN ** DEPTH`` consecutive leaves, which ``aggregate`` collapses level by level with
``sequence``, ``slice`` and ``transform``; the blocks' roots are the leaves of the next round, until each group has one node.
Every full block collapses exactly ``DEPTH`` levels, and so does the last one of a group with several blocks, so the blocks
give the same tree as the whole. A leaf's path (the siblings before and after it at each level) is that within its block, then its block's.

Rows get their places by a range partitioning of (group, key, digest), so that a group of any share of all rows is dealt to many tasks, and
equal rows by their place in the input besides; no task holds more than a block's leaves as one row.

Rows: nulls hash as ``-``, empty texts as ``0:``; texts are hashed whole; a null key stands first, equal keys in the order of their digests;
equal rows are leaves of their own, which one of them has which place doesn't matter; a null group is one of its own and stands first; an empty table
gives no rows. Columns are those named; the result's columns are fixed, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch, sized

FAN, DEPTH = 2, 12
_PATH = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def placed(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """rows with ``place`` (from 0) in their group by the order, nulls first, and ``n``, the group's rows.

    The sorted table is written, then numbered by the count of rows before each (part, group): at most as many as parts and groups.
    """
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in [group, *order, "_salt"]]
    at = F.monotonically_increasing_id()
    parts = scratch.cut(salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt").withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)))
    tops = parts.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    each = W.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(each.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = scratch.cut(tops.select(F.col("_part").alias("_p"), "_group", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(each).alias("n")))
    both = parts.join(sized(tops, tops.count()), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return both.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_group", "_shift")


def levels(leaves: Column, steps: Column, fan: int) -> Column:
    """The arrays of nodes of ``steps`` collapses, from the leaves up."""

    def above(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int"))
        return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * fan + 1, fan), "")))

    return F.aggregate(F.sequence(F.lit(1), steps), F.array(leaves), lambda have, _: F.concat(have, F.array(above(F.element_at(have, -1)))))


def path(nodes: Column, i: Column, fan: int) -> Column:
    """The siblings before and after place i at each level but the top: array<struct<before, after>>."""

    def siblings(level: Column, up: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(float(fan)), up)).cast("int")
        run = F.slice(level, at - at % fan + 1, fan)
        return F.struct(F.array_join(F.slice(run, 1, at % fan), "").alias("before"), F.array_join(F.slice(run, at % fan + 2, fan), "").alias("after"))

    return F.transform(F.slice(nodes, 1, F.size(nodes) - 1), siblings)


def build(nodes: DataFrame, scratch: Scratch, fan: int = FAN, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Blocks (group, block, items, levels), and for each block (g, b, top, upper): its group's last node and the path to it.

    nodes: (group, place, n, node, item), item being any struct and n the group's nodes. A group of one block collapses to one node,
    the blocks of others ``depth`` levels each.
    """
    size, powers = fan**depth, [fan**d for d in range(depth)]
    rows = nodes.select("group", F.floor(F.col("place") / size).cast("long").alias("block"), "n", F.struct("place", "node", "item").alias("x"))
    blocks = rows.groupBy("group", "block").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("x")).alias("items"))
    steps = F.when(F.col("n") > size, depth).otherwise(F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < F.col("n"))))
    leaves = F.col("items.node")
    # no step at all is a case of its own, as sequence(1, 0) runs downward
    every = F.when(steps > 0, levels(leaves, steps, fan)).otherwise(F.array(leaves))
    blocks = scratch.cut(blocks.select("group", "block", "n", F.transform("items", lambda x: x["item"]).alias("items"), every.alias("levels")))
    heads = scratch.cut(blocks.select("group", "block", "n", F.element_at(F.element_at("levels", -1), 1).alias("root")))
    up = heads.where(F.col("n") <= size).select(F.col("group").alias("g"), F.col("block").alias("b"), F.col("root").alias("top"), F.array().cast(_PATH).alias("upper"))
    more = heads.where(F.col("n") > size)
    if not more.isEmpty():
        fewer = F.ceil(F.col("n") / size).cast("long").alias("n")
        above = expand(*build(more.select("group", F.col("block").alias("place"), fewer, F.col("root").alias("node"), F.struct("block").alias("item")), scratch, fan, depth), fan)
        up = up.unionByName(above.select(F.col("group").alias("g"), F.col("item.block").alias("b"), "top", F.col("path").alias("upper")))
    return blocks, scratch.cut(up)


def expand(blocks: DataFrame, up: DataFrame, fan: int = FAN) -> DataFrame:
    """(group, item, path, and the columns of up but g, b and upper) for each node of the blocks."""
    # a path has few siblings: eight rows' width is more than it takes
    both = blocks.join(sized(up, up.count() * 8), (F.col("block") == F.col("b")) & F.col("group").eqNullSafe(F.col("g")))
    paths = F.transform("items", lambda item, i: F.struct(item.alias("item"), F.concat(path(F.col("levels"), i, fan), F.col("upper")).alias("path")))
    rest = [c for c in up.columns if c not in ("g", "b", "upper")]
    return both.select("group", *rest, F.explode(paths).alias("x")).select("group", *rest, "x.item", "x.path")


def fold(node: Column, steps: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(steps, node, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def proof(steps: Column) -> Column:
    """The digest of all siblings of a path."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(leaves: DataFrame, group: str = "lang", key: str = "doc_id", carry: tuple[str, ...] = (), fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(group, key, leaf, carried columns, subroot, root, path) of rows (group, key, leaf, ...); ``path`` leads from leaf to root."""
    scratch = Scratch(leaves.sparkSession, "merkle")
    item = F.struct(F.col(f"`{key}`").alias("key"), "leaf", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("item")
    rows = leaves.select(F.col(f"`{group}`").alias("group"), F.col(f"`{key}`").alias("key"), F.col("leaf").alias("node"), item)
    blocks, up = build(placed(rows, "group", ["key", "node"], scratch), scratch, fan, depth)
    names = up.select(F.lit(0).alias("group"), F.col("g").alias("name"), F.col("top").alias("node"), F.struct(F.col("g").alias("name")).alias("item")).distinct()
    tops = expand(*build(placed(names, "group", ["name"], scratch), scratch, fan, depth), fan)
    tops = scratch.cut(tops.select(F.col("item.name").alias("name"), F.col("top").alias("root"), "path"))
    whole = up.join(sized(tops, tops.count() * 8), F.col("g").eqNullSafe(F.col("name")))
    whole = scratch.cut(whole.select("g", "b", F.col("top").alias("subroot"), "root", F.concat("upper", "path").alias("upper")))
    out = expand(blocks, whole, fan)
    more = [F.col(f"item.c{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(F.col("group").alias(group), F.col("item.key").alias(key), "item.leaf", *more, "subroot", "root", "path")
