"""Markdown structure and chunking: heading hierarchy, logical blocks, sentence packing with overlap."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sentences as sentences_of

LEVELS = range(1, 7)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, value)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))


def hierarchy(rows: DataFrame) -> DataFrame:
    """Each line with its heading level and the headings h1..h6 in force; a higher heading clears the lower ones."""
    hashes = F.length(F.regexp_extract("value", r"^(#{1,6})\s+\S", 1))
    title = F.trim(F.regexp_replace("value", r"^#+\s*", ""))
    so_far = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("level", hashes).withColumn("title", F.when(F.col("level") > 0, title))
    for i in LEVELS:
        at = F.max(F.when(F.col("level") == i, F.col("line"))).over(so_far)
        above = F.max(F.when((F.col("level") > 0) & (F.col("level") < i), F.col("line"))).over(so_far)
        name = F.last(F.when(F.col("level") == i, F.col("title")), ignorenulls=True).over(so_far)
        out = out.withColumn(f"h{i}", F.when(at > F.coalesce(above, F.lit(-1)), name))
    return out


def sections(rows: DataFrame) -> DataFrame:
    """(doc_id, section, heading, level, h1..h6, content): lines under each heading, in order."""
    so_far = W.partitionBy("doc_id").orderBy("line")
    marked = hierarchy(rows).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(so_far))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line", "value")))), lambda x: x["value"]), "\n")
    first = [F.max(f"h{i}").alias(f"h{i}") for i in LEVELS]
    return marked.groupBy("doc_id", "section").agg(F.max("title").alias("heading"), F.max("level").alias("level"), *first, body.alias("content"))


def chunk_type(names: list[str]) -> Column:
    """Non-blank headings joined by hyphens, else unknown."""
    parts = F.filter(F.array(*names), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.when(F.size(parts) > 0, F.array_join(parts, "-")).otherwise("unknown")


def structure_report(rows: DataFrame) -> DataFrame:
    """(doc_id, headings, max_depth, jumps, repeated): counts of heading levels that skip one, and of repeated titles."""
    heads = hierarchy(rows).where("level > 0").withColumn("last", F.lag("level", 1, 0).over(W.partitionBy("doc_id").orderBy("line")))
    return heads.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("headings"), F.max("level").alias("max_depth"), F.sum((F.col("level") > F.col("last") + 1).cast("long")).alias("jumps"),
        (F.count(F.lit(1)) - F.countDistinct("title")).alias("repeated"),
    )


def logical_blocks(rows: DataFrame, boundary: Column) -> DataFrame:
    """(doc_id, block, text): lines from one boundary line to the next; blank blocks are left out."""
    so_far = W.partitionBy("doc_id").orderBy("line")
    block = rows.withColumn("block", F.sum(boundary.cast("int")).over(so_far))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    return block.groupBy("doc_id", "block").agg(text.alias("text")).where(F.trim("text") != "")


def pack(sentences: list[str], most: int, overlap: int, count: Callable[[str], int]) -> list[str]:
    """Fill chunks greedily up to ``most`` tokens; the next begins with the last words of at most ``overlap`` tokens."""
    out, held, size = [], [], 0
    for s in sentences:
        n = count(s)
        if held and size + n > most:
            out.append(" ".join(held))
            tail = " ".join(held).split()[-overlap:] if overlap else []
            held = [" ".join(tail)] if tail and count(" ".join(tail)) + n <= most else []
            size = count(held[0]) if held else 0
        held.append(s)
        size += n
    return [*out, " ".join(held)] if held else out


def chunk(docs: DataFrame, sentences: Column, most: int = 512, overlap: int = 50, count: Callable[[str], int] | None = None) -> DataFrame:
    """(doc_id, chunk, text). Packing is sequential within a text, so it is one Arrow-batched function of the sentences."""
    counter = count or (lambda s: len(s.split()))

    @F.pandas_udf("array<string>")
    def packed(col: pd.Series) -> pd.Series:
        return col.map(lambda s: pack(list(s), most, overlap, counter) if s is not None else [])

    return docs.select("doc_id", F.posexplode(packed(sentences)).alias("chunk", "text"))


def split_large(chunks: DataFrame, most: int = 512, overlap: int = 50, beyond: float = 1.2, count: Callable[[str], int] | None = None) -> DataFrame:
    """Chunks (..., text) of more than ``beyond`` times ``most`` tokens cut into pieces of whole sentences; the other columns stay with each.

    ``piece`` counts from 0; chunks that are small enough are piece 0 as they are. Pieces overlap as in ``pack``; a longer sentence is a piece of its own.
    """
    counter = count or (lambda s: len(s.split()))

    @F.pandas_udf("array<string>")
    def pieces(text: pd.Series, said: pd.Series) -> pd.Series:
        cut = lambda t, s: [t] if t is None or counter(t) <= most * beyond else pack(list(s), most, overlap, counter)
        return pd.Series([cut(t, s) for t, s in zip(text, said, strict=True)], dtype=object)

    rest = [F.col(c) for c in chunks.columns if c != "text"]
    return chunks.select(*rest, F.posexplode(pieces(F.col("text"), sentences_of(F.col("text")))).alias("piece", "text"))


def optimise_fully(chunks: DataFrame, tokens: Column, most: int = 512, overlap: int = 50) -> DataFrame:
    """Small chunks joined to the one before (``optimise``), then those beyond 1.2 times ``most`` split with overlap: (doc_id, section, chunk, piece, text)."""
    return split_large(optimise(chunks, tokens, most).drop("tokens"), most, overlap)


def register_chunk_function(spark, name: str = "chunk_text", most: int = 512, overlap: int = 50) -> None:
    """A table function name(text) -> (chunk, text) for SQL's lateral joins, packing sentences as ``chunk`` does."""
    import re

    end, semicolon, blank = re.compile(r"(?<=[。！？?!])\s*", re.ASCII), re.compile(r"(?<=;)"), " \t\n\x0b\f\r"

    @F.udtf(returnType="chunk int, text string")
    class ChunkText:
        def eval(self, text: str):
            said = [s.strip(blank) for p in end.split(text or "") for s in semicolon.split(p)]
            yield from enumerate(pack([s for s in said if s not in ("", ";")], most, overlap, lambda s: len(s.split())))

    spark.udtf.register(name, ChunkText)


def optimise(chunks: DataFrame, tokens: Column, most: int = 512, least: float = 0.3) -> DataFrame:
    """Join small chunks to the one before: (doc_id, section, chunk, text) with less than ``least`` of ``most`` tokens.

    Chunks of one section of a text are joined greedily in their order while the sum stays within ``most``; what is
    joined is parted by an empty line and takes the number of its first chunk.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk", tokens.cast("long").alias("n"), "text")))
    small = most * least

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["chunk"].alias("chunk"), (last["n"] + x["n"]).alias("n"), F.concat(last["text"], F.lit("\n\n"), x["text"]).alias("text"))
        fits = (F.size(done) > 0) & (x["n"] < small) & (last["n"] + x["n"] <= most)
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    empty = F.array().cast("array<struct<chunk:int,n:bigint,text:string>>")
    each = chunks.withColumn("chunk", F.col("chunk").cast("int")).groupBy("doc_id", "section").agg(ordered.alias("c"))
    return each.select("doc_id", "section", F.explode(F.aggregate("c", empty, step)).alias("x")).select("doc_id", "section", "x.chunk", F.col("x.n").alias("tokens"), "x.text")
