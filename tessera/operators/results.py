"""Hits as an engine returns them and as a reranker takes them: projections, candidates, results put back by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import top_k
from .ranking import top_up_variant

#: The fields of a hit beside id, score and text, and what stands for a missing one.
HIT_FIELDS = {"faction": "", "content_type": "", "section_heading": "", "h1": "", "h2": "", "h3": "", "source_file": "", "chunk_index": 0, "created_at": ""}
#: Those that go on without reranking, and to a reranker.
PLAIN_FIELDS = ("faction", "content_type", "section_heading", "source_file", "chunk_index")


def _value(rows: DataFrame, name: str) -> Column:
    missing = HIT_FIELDS[name]
    kind = "int" if isinstance(missing, int) else "string"
    return (F.coalesce(F.col(name).cast(kind), F.lit(missing)) if name in rows.columns else F.lit(missing)).alias(name)


def hits(found: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, rank, id, score, text, and HIT_FIELDS) of found rows (query_id, doc_id, score, rank) of an index; missing fields are empty."""
    both = found.select("query_id", "doc_id", "score", "rank").join(index, "doc_id")
    return both.select("query_id", "rank", F.col("doc_id").alias("id"), "score", "text", *[_value(both, c) for c in HIT_FIELDS])


def without_rerank(given: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with their question, where no reranker runs: (query_id, rank, id, text, score, query, PLAIN_FIELDS)."""
    both = given.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return both.select("query_id", "rank", "id", F.coalesce("text", F.lit("")).alias("text"), "score", "query", *PLAIN_FIELDS)


def candidates(given: DataFrame) -> DataFrame:
    """What a reranker takes: hits with text, ``place`` counting them from 0 in their order."""
    kept = given.where("text <> ''")
    return top_k(kept, 1 << 30, score="score", tie="id").withColumn("place", F.col("rank") - 1).select("query_id", "place", "text", "score", "id", *PLAIN_FIELDS)


def put_back(given: DataFrame, reranked: DataFrame) -> DataFrame:
    """Hits in a reranker's order with its scores (query_id, place, score); places beyond the candidates are left out, a query without results keeps its hits."""
    placed = candidates(given).select("query_id", "place", "id")
    new = reranked.select("query_id", "place", F.col("score").alias("_score")).join(placed, ["query_id", "place"]).drop("place")
    asked = reranked.select("query_id").distinct().withColumn("_asked", F.lit(True))
    both = given.join(asked, "query_id", "left").join(new, ["query_id", "id"], "left").where("_asked is null or _score is not null")
    return top_k(both.withColumn("score", F.coalesce("_score", "score")).drop("_score", "_asked", "rank"), 1 << 30, tie="id")


def distinct_texts(given: DataFrame) -> DataFrame:
    """Of a query's hits with one text the best, ties by id: what a reranker that pays by the text is sent."""
    best = F.max_by(F.struct(*[c for c in given.columns if c not in ("query_id", "text")]), F.struct("score", -F.col("id")))
    return given.groupBy("query_id", "text").agg(best.alias("x")).select("query_id", "text", "x.*")


#: The strategies of the fallback by name; unknown names give the levels.
FALLBACKS = {"score_sort": "score", "random": "random", "original": "original", "multi_level": "levels"}


def ensure_results(given: DataFrame, least: int, strategy: str = "multi_level") -> DataFrame:
    """Hits (query_id, doc_id, score, rank), topped up by a strategy where a query has fewer than ``least``."""
    return top_up_variant(given, least, FALLBACKS.get(strategy, "levels"))
