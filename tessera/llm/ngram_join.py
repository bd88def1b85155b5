"""Jaccard self-join of word n-gram sets with prefix filters under several global token orders.

Method. A document's set holds the distinct hashed shingles of its words. Copies of one set are one entity. Sets of
n and m tokens link at a Jaccard similarity of t when they have a = ceil(t (n + m) / (1 + t)) tokens in common, and then
share a token among the first n - a + 1 and m - a + 1 of them, under *every* global token order. The first order is by rising corpus frequency (counted over all documents in a
sketch of fixed size), so that its prefixes hold rare tokens and common passages stay out of them; the others
order frequency classes by different scrambles. Candidates come from the first order's prefix and must overlap in
the prefixes of all other orders before their sets are compared exactly.

No group is expanded into all its pairs. Lists hold the entities of one prefix token and one range of set sizes. In
rounds, a list's entities are compared with one of them, then those outside the list's largest component with a few
of that component, and in the end those still outside with all of the list. Verified links join components between
the rounds, so that only pairs that are already connected are skipped and no link between components is lost.

Rows: a null, empty or all-white-space text has the empty set (n_shingles 0) and is alone in its component; rows of
a repeated doc_id are judged each by its own text; a row without doc_id gets its n_shingles, a null component_id,
and links nothing. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import buffers, chunks, mix, shingles, space_table, words
from .store import Scratch, give_back, sized

#: Bits of the frequency sketch: 2**bits counters are sent to every executor (2 MB). Only the order of tokens
#: depends on the counters, never the result.
SKETCH_BITS = 18
#: Token orders whose prefixes must overlap, the first included.
ORDERS = 3
#: Rounds: against one of the list; those left, against about so many of the list's largest component; then against all.
STEPS = ("one", 8, 64, "all")


def _sets(data: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) for every row."""
    for i, j in chunks(bounds):
        part = data[bounds[i] : bounds[j]]
        h, at = shingles(*words(part, bounds[i : j + 1] - bounds[i], space_table()), k)
        for r in range(j - i):
            s = h[at[r] : at[r + 1]]
            s.sort()
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield i + r, s


def _signature(s: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    total = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _ceil(factor: int, what: str, by: int) -> str:
    """SQL for the ceiling of factor * what / by."""
    return f"(({factor} * {what} + {by - 1}) div {by})"


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _profile(k: int, bits: int):
    """Rows of documents (kind 0: id, n, ent) and of the frequency sketch (kind 1: id is the counter, n its count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << bits, np.int64), [], 0
        for batch in batches:
            data, bounds = buffers(batch.column(1))
            n, ent = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for r, s in _sets(data, bounds, k):
                n[r] = len(s)
                ent[r] = _signature(s)
                held.append(s >> np.uint64(64 - bits))
                size += len(s)
                if size > 1 << 18:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
                    held, size = [], 0
            yield pa.record_batch([pa.array(np.zeros(len(batch), np.int32)), batch.column(0).cast(pa.int64()), pa.array(n), pa.array(ent)], names=["kind", "id", "n", "ent"])
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(counts[at]), pa.array(np.zeros(len(at), np.int64))], names=["kind", "id", "n", "ent"])

    return run


def _ordered(s: np.ndarray, counts: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Positions of a sorted set's tokens under one of the global orders."""
    c = np.minimum(counts[(s >> np.uint64(64 - bits)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
    if order:
        c = np.frexp(c.astype(np.float64))[1].astype(np.uint64)
    tail = s if order == 0 else mix(s + np.uint64(order))
    return np.argsort((c << np.uint64(40)) | (tail >> np.uint64(24)), kind="stable")


def _emit(batches: Iterator[pa.RecordBatch], k: int, lists: str, kind: type, of: Callable[[np.ndarray], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(ent, n, list) of every row that has shingles, in record batches of about a million values."""
    none = pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.list_(pa.from_numpy_dtype(kind)))], names=["ent", "n", lists])
    for batch in batches:
        ent, n, parts, at = [], [], [], [0]
        for _, s in _sets(*buffers(batch.column(0)), k):
            if len(s):
                values = of(s)
                ent.append(_signature(s))
                n.append(len(s))
                parts += values
                at.append(at[-1] + sum(map(len, values)))
                if at[-1] > 1 << 20:
                    yield pa.record_batch([pa.array(ent), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(np.array(at, np.int32)), pa.array(np.concatenate(parts)))], names=none.schema.names)
                    ent, n, parts, at = [], [], [], [0]
        if ent:
            yield pa.record_batch([pa.array(ent), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(np.array(at, np.int32)), pa.array(np.concatenate(parts)))], names=none.schema.names)
    yield none


def _prefixes(k: int, percent: int, bits: int, counts):
    """(ent, n, prefix): the first order's prefix of every row that has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.asarray(counts.value)
        yield from _emit(batches, k, "prefix", np.int64, lambda s: [s[_ordered(s, table, 0, bits)[: _prefix(len(s), percent)]].view(np.int64)])

    return run


def _others(k: int, percent: int, bits: int, orders: int, counts):
    """(ent, n, more): the prefixes under the other orders one after another, as 32-bit hashes of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.asarray(counts.value)

        def of(s: np.ndarray) -> list[np.ndarray]:
            low, p = s.astype(np.uint32).view(np.int32), _prefix(len(s), percent)
            return [low[_ordered(s, table, o, bits)[:p]] for o in range(1, orders)]

        yield from _emit(batches, k, "more", np.int32, of)

    return run


def _whole(k: int):
    """(ent, n, tokens): whole sets."""
    return lambda batches: _emit(batches, k, "tokens", np.int64, lambda s: [s.view(np.int64).copy()])


def _lists(percent: int) -> F.Column:
    """Two lists (key, grid) for a token and a set size: sizes whose ratio allows a link share one of them.

    Sizes fall into geometric ranges twice as wide as the ratio, in two grids that are shifted by half a range. In the
    second grid, base (the range in the first) tells pairs that meet in the first as well.
    """
    x = F.log(F.col("n")) / F.lit(max(-math.log(percent / 100) * 1.001, 1e-9))
    grids = [F.struct(F.xxhash64("token", F.lit(g), F.floor((x + g) / 2)).alias("key"), (F.floor(x / 2) if g else F.lit(None).cast("long")).alias("base")) for g in (0, 1)]
    return F.array(*grids)


def ngram_jaccard(docs: DataFrame, k: int = 5, percent: int = 80, orders: int = ORDERS, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id that links reach.

    Two documents link when 100 |A n B| >= percent |A u B| for their sets of k-word shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = scratch.cut(keyed.mapInArrow(_profile(k, sketch_bits), "kind int, id long, n long, ent long"))
    rows = profile.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "ent")
    found = profile.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << sketch_bits, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    del found
    give_back()
    sketch = spark.sparkContext.broadcast(counts)

    prefix = scratch.cut(keyed.where("doc_id is not null").select("text").mapInArrow(_prefixes(k, percent, sketch_bits, sketch), "ent long, n int, prefix array<long>"))
    tokens = prefix.select("ent", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("early", F.expr(f"pos <= n - {_ceil(2 * percent, 'n', 100 + percent)}"))
    shared = tokens.groupBy("token").agg(F.min("ent").alias("lo"), F.max("ent").alias("hi"), F.max("early").alias("early")).where("lo <> hi and early").select("token")
    postings = tokens.join(shared, "token").select(F.explode(_lists(percent)).alias("list"), "ent", "n", "pos", "early").select("list.*", "ent", "n", "pos", "early")
    postings = scratch.cut(postings.groupBy("key", "ent").agg(F.first("n").alias("n"), F.first("base").alias("base"), F.min("pos").alias("pos"), F.max("early").alias("early")))
    scratch.drop(prefix)
    postings = scratch.cut(_open(postings.withColumn("comp", F.col("ent")))).drop("comp")

    first = rows.where("n > 0 and doc_id is not null").groupBy("ent").agg(F.min("doc_id").alias("doc_id"))
    chosen = scratch.cut(first.join(postings.select("ent").distinct(), "ent", "left_semi").select("doc_id", "ent"))

    def texts(ents: DataFrame) -> DataFrame:
        ids = scratch.cut(chosen.join(ents, "ent", "left_semi").select("doc_id"))
        return keyed.join(sized(ids, ids.count()), "doc_id", "left_semi").select("text")

    more = texts(postings.select("ent").distinct()).mapInArrow(_others(k, percent, sketch_bits, orders, sketch), "ent long, n int, more array<int>")
    more = scratch.cut(more.dropDuplicates(["ent"]))
    links = comp = sets = None
    for step in STEPS:
        here = postings.withColumn("comp", F.col("ent"))
        if comp is not None:
            here = postings.join(comp.withColumnRenamed("id", "ent"), "ent", "left").withColumn("comp", F.coalesce("comp", "ent"))
            here = scratch.cut(_open(here))
        pairs = _against_one(here) if step == "one" else _outsiders(here, None if step == "all" else step)
        common = _ceil(percent, "(na + nb)", 100 + percent)
        pairs = pairs.where(f"ca <> cb and (ba is null or ba <> bb) and pa <= na - {common} and pb <= nb - {common}").withColumn("common", F.expr(common))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common").distinct()
        pairs = scratch.cut(_overlapping(pairs, more, orders))
        wanted = pairs.select(F.col("a").alias("ent")).union(pairs.select("b")).distinct()
        if sets is not None:
            wanted = wanted.join(sets.select("ent"), "ent", "left_anti")
        wanted = scratch.cut(wanted)
        if not wanted.isEmpty():
            got = scratch.cut(texts(wanted).mapInArrow(_whole(k), "ent long, n int, tokens array<long>").dropDuplicates(["ent"]).select("ent", "tokens"))
            sets = got if sets is None else sets.unionAll(got)
        if sets is None:
            continue
        new = scratch.cut(_linked(pairs, sets, percent))
        if new.isEmpty():
            continue
        links = new if links is None else links.unionAll(new)
        comp = components(links, scratch)

    ids = rows.where("n > 0 and doc_id is not null")
    if comp is None:
        comp = spark.createDataFrame([], "id long, comp long")
    linked = comp.select(F.col("id").alias("ent"), "comp")
    smallest = ids.groupBy("ent").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).join(linked, "ent", "left")
    smallest = scratch.cut(smallest.where("comp is not null or copies > 1").withColumn("comp", F.coalesce("comp", "ent")))
    least = smallest.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_ent = scratch.cut(smallest.join(least, "comp").select("ent", "component_id"))
    out = rows.join(sized(by_ent, by_ent.count()), "ent", "left")
    member = F.expr("n > 0 and doc_id is not null")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(member, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _open(here: DataFrame) -> DataFrame:
    """Rows of lists that hold more than one component, and the token early enough for a link."""
    lists = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("early").alias("early")).where("lo <> hi and early").select("key")
    return here.join(lists, "key")


def _side(here: DataFrame, x: str) -> DataFrame:
    return here.select("key", F.col("ent").alias(x), F.col("n").alias("n" + x), F.col("pos").alias("p" + x), F.col("base").alias("b" + x), F.col("comp").alias("c" + x))


def _against_one(here: DataFrame) -> DataFrame:
    """Each entity of a list against one of the list, the same of a group in all the group's lists."""
    pivot = here.where("early").groupBy("key").agg(F.min(F.struct(F.xxhash64("ent"), "ent", "n", "pos", "base", "comp")).alias("p")).select("key", "p.*")
    return _side(here, "a").join(_side(pivot, "b"), "key")


def _outsiders(here: DataFrame, pivots: int | None) -> DataFrame:
    """Entities outside their list's largest component against about so many of that component, or all of the list."""
    sizes = here.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"), F.col("m.c").alias("c"))
    known = here.join(most, "key")
    few = known.where("comp <> main")
    if pivots is not None:
        every = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.col("c") / pivots)), F.lit(0))).cast("long")
        known = known.where((F.col("comp") == F.col("main")) & (F.pmod(F.xxhash64(F.lit(pivots), F.col("ent")), every) == 0))
    # in a pair that passes, the smaller set has the token early
    pairs = _side(known.where("early"), "a").join(_side(few, "b"), "key").where("nb >= na")
    return pairs.unionByName(_side(known, "a").join(_side(few.where("early"), "b"), "key").where("na > nb"))


def _overlapping(pairs: DataFrame, more: DataFrame, orders: int) -> DataFrame:
    """Pairs whose prefixes overlap under every other order as well."""
    if orders < 2:
        return pairs
    a, b = (more.select(F.col("ent").alias(x), F.col("n").alias("n" + x), F.col("more").alias("m" + x)) for x in "ab")
    ok = F.lit(True)
    for o in range(orders - 1):
        part = [F.expr(f"slice(m{x}, cast(size(m{x}) / {orders - 1} as int) * {o} + 1, cast(n{x} - common + 1 as int))") for x in "ab"]
        ok = F.when(ok, F.arrays_overlap(*part)).otherwise(False)
    return pairs.join(a, "a").join(b, "b").where(ok).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets link."""
    a, b = (sets.select(F.col("ent").alias(x), F.col("tokens").alias("t" + x)) for x in "ab")
    inter = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").where(100 * inter >= percent * (F.size("ta") + F.size("tb") - inter)).select("a", "b")
