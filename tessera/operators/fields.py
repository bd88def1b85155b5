"""Search over several fields: BM25 for each field, best-field scores, score fusion, parameters by query and depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, words
from .lexical import saturation, term_counts, top_k
from .ranking import normalise

# Weights of heading and metadata fields.
HEADING_WEIGHTS = {"h1": 1.0, "h2": 1.5, "h3": 1.6, "h4": 0.6, "h5": 0.5, "h6": 0.4}
METADATA_WEIGHTS = {"section_heading": 1.0, "sub_section": 1.2, "content_type": 1.0, "chunk_type": 1.4, "faction": 1.3}


def field_scores(docs: DataFrame, queries: DataFrame, weights: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, field, score): the weighted BM25 of each field, with the field's own statistics.

    All fields are exploded in one pass over docs, and only terms of the queries are joined. A document counts for a
    field when it has a token there. Blank fields and terms that no query has cost no shuffle of their own.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(w)).alias("boost"), F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias("t")) for f, w in weights.items()]))
    rows = docs.select("doc_id", each.alias("x")).select("doc_id", "x.*").where(F.size("t") > 0).withColumn("dl", F.size("t"))
    sizes = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    q = term_counts(queries, "query_id", "text", "qtf")
    tf = rows.select("doc_id", "field", "boost", "dl", F.explode("t").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    tf = tf.groupBy("doc_id", "field", "boost", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(sizes), "field")
    idf = df.select("field", "term", "avgdl", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hits = tf.join(idf, ["field", "term"]).join(q, "term")
    score = F.sum(F.col("qtf") * F.col("boost") * F.col("idf") * saturation(k1, b))
    return hits.groupBy("query_id", "doc_id", "field").agg(score.alias("score"))


def best_of_fields(scores: DataFrame, tie: float = 0.3) -> DataFrame:
    """(query_id, doc_id, score): the best field and a share of the others."""
    best, total = F.max("score"), F.sum("score")
    return scores.groupBy("query_id", "doc_id").agg(F.round(best + tie * (total - best), 6).alias("score"))


def content_boost(query: Column, short: int = 12, medium: int = 20, boosts: tuple[float, float, float] = (1.2, 1.2, 1.4)) -> Column:
    """The weight of the text field by the query's words: short, medium or long."""
    n = F.size(words(query))
    return F.when(n > medium, boosts[2]).when(n > short, boosts[1]).otherwise(boosts[0])


def mean_fusion(lists: list[DataFrame], weights: list[float] | None = None, k: int = 10) -> DataFrame:
    """The weighted mean of min-max scaled scores; a list without the document counts 0."""
    ws = weights or [1.0] * len(lists)
    parts = [normalise(x, "minmax").select("query_id", "doc_id", (F.col("norm") * w / sum(ws)).alias("part")) for x, w in zip(lists, ws, strict=True)]
    every = reduce(lambda a, b: a.unionAll(b), parts)
    return top_k(every.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")), k)


def rrf_parameters(depth: int, multiplier: int = 3, constant: int = 20, most: int = 300) -> dict[str, int]:
    """Window and constant of a rank fusion for a result depth."""
    if depth <= 0 or multiplier <= 0 or constant <= 0:
        raise ValueError("depth, multiplier and constant must be positive")
    return {"window": min(depth * multiplier, most), "constant": constant}


def variants_fusion(hits: DataFrame, constant: int = 60, window: int = 100, k: int = 10) -> DataFrame:
    """Ranked hits (query_id, variant, doc_id, rank) of a query's variants as one ranking: sum of 1 / (constant + rank)."""
    part = hits.where(F.col("rank") <= window).groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))
    return top_k(part, k)
