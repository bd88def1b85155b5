"""Search engines over one index table: dense, fused by rank, weighted, and five sub-queries; filters, reranking, dispatch.

An index table has doc_id, text, embedding, h1..h6 and the metadata fields of ``fields.METADATA_WEIGHTS``; queries have
query_id, text and qv.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import bounded, cut
from . import fields, fieldscan, lexical, ranking, scan

#: Sub-queries of the five-part search.
PARTS = ("heading", "bm25", "content", "metadata", "dense")
HEADINGS = list(fields.HEADING_WEIGHTS)
# Words of a question that ask for rules or for units, and the filters that they set.
RULE_WORDS = ["规则", "规则书", "codex", "FAQ"]
UNIT_WORDS = ["单位", "模型", "unit", "数据表"]


def smart_filter(query: Column) -> dict[str, Column]:
    """content_type and chunk_type that a question's words ask for, else null; rules come before units."""
    any_of = lambda ws: reduce(lambda a, b: a | b, [query.contains(w) for w in ws])
    rule = any_of(RULE_WORDS)
    return {"content_type": F.when(rule, "corerule"), "chunk_type": F.when(~rule & any_of(UNIT_WORDS), "unit_data")}


def merge_filters(given: dict, found: dict) -> dict:
    """The caller's filters, and those found for names that the caller left open; without a caller's filter none is added."""
    return {**{k: v for k, v in found.items() if v is not None}, **given} if given else {}


def long_enough(text: Column, least: int = 10) -> Column:
    """Texts of so many characters after trimming are worth a result."""
    return F.length(F.trim(text)) >= least


def five_parts(index: DataFrame, queries: DataFrame, k: int = 10, dense_boost: float = 1.0, tie: float = 0.3) -> DataFrame:
    """(query_id, doc_id, heading, bm25, content, metadata, dense, score, rank): the mean of five min-max scaled sub-queries.

    Headings count by their best field and a share of the others, metadata by their best field, content by the question's
    length. The tasks score and scale all text fields in scans of the index; the parts' scaled scores stay in the row as an explanation. Only a query's
    nearest vectors and its k best by the other parts can be among its k best.
    """
    near = ranking.knn(index.select("doc_id", "embedding"), queries.select("query_id", "qv"), min(100, 3 * k))
    near = cut(near.select("query_id", "doc_id", (F.col("score") * dense_boost).alias("dense")))
    lex = fieldscan.four_parts(index, queries, fields.HEADING_WEIGHTS, fields.METADATA_WEIGHTS, near, k, tie)
    q = W.partitionBy("query_id")
    x, lo, hi = F.col("dense"), F.min("dense").over(q), F.max("dense").over(q)
    near = near.withColumn("dense", F.round(F.when(x.isNull(), 0.0).when(hi == lo, 0.5).otherwise((x - lo) / (hi - lo)), 6))
    every = lex.join(near, ["query_id", "doc_id"], "full").na.fill(0.0, list(PARTS)).select("query_id", "doc_id", *PARTS)
    return lexical.top_k(every.withColumn("score", F.round(sum(F.col(p) for p in PARTS) / 5.0, 6)), k)


def dense(index: DataFrame, queries: DataFrame, k: int = 10, least: int = 10) -> DataFrame:
    """Dense search, reranked by shared tokens, without texts that are too short: (query_id, doc_id, score, rank)."""
    hits = ranking.knn(index.select("doc_id", "embedding"), queries.select("query_id", "qv"), 3 * k).drop("rank")
    hits = hits.join(index.select("doc_id", "text").where(long_enough(F.col("text"), least)), "doc_id").join(bounded(queries.select("query_id", F.col("text").alias("q"))), "query_id")
    score = ranking.overlap_score(F.array_distinct(words(F.lower("q"))), F.array_distinct(words(F.lower("text"))))
    return ranking.rerank(hits.select("query_id", "doc_id", "text", "q", "score"), score, k).select("query_id", "doc_id", "score", "rank")


def rank_fusion(index: DataFrame, queries: DataFrame, k: int = 10, multiplier: int = 3, constant: int = 20) -> DataFrame:
    """Lexical and dense lists of the window's depth, fused by rank."""
    p = fields.rrf_parameters(k, multiplier, constant)
    lex = scan.Corpus(index.select("doc_id", "text")).search(queries.select("query_id", "text"), p["window"])
    near = ranking.knn(index.select("doc_id", "embedding"), queries.select("query_id", "qv"), p["window"])
    return ranking.rrf([lex, near], p["constant"], p["window"], k).select("query_id", "doc_id", "score", "rank")


ENGINES: dict[str, Callable[..., DataFrame]] = {"dense": dense, "rrf": rank_fusion, "pipeline": lambda i, q, k=10: five_parts(i, q, k).select("query_id", "doc_id", "score", "rank")}
# The engine of each intent; others use the dense one.
INTENT_ENGINES = {"query": "rrf", "list": "rrf", "rule": "pipeline", "compare": "pipeline"}


def engine(name: str) -> Callable[..., DataFrame]:
    """An engine by name; unknown names give the dense one, which every other falls back to."""
    return ENGINES.get(name, dense)


def dispatch(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Queries with an intent, each answered by its intent's engine; those that a lexical engine finds nothing for by the dense one."""
    kind = F.coalesce(reduce(lambda c, x: c.when(F.col("intent") == x[0], x[1]), INTENT_ENGINES.items(), F.when(F.lit(False), "")), F.lit("dense"))
    asked = queries.withColumn("engine", kind)
    parts = [engine(e)(index, asked.where(F.col("engine") == e), k).withColumn("engine", F.lit(e)) for e in ENGINES]
    return reduce(DataFrame.unionByName, parts)


def by_entity(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The nearest documents of each query among those one of whose headings is the query's entity."""
    heads = index.where("embedding is not null").select("doc_id", "embedding", F.explode(F.array_distinct(F.array_compact(F.array(*HEADINGS)))).alias("entity"))
    hits = heads.join(bounded(queries.select("query_id", "qv", "entity")), "entity")
    return lexical.top_k(hits.select("query_id", "doc_id", F.round(ranking.dot(F.col("embedding"), F.col("qv")), 6).alias("score")), k)


def fuzzy_terms(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, term, distance): terms (term) within 0, 1 or 2 edits of words (word) of up to 2, up to 5 and more letters.

    Terms and words meet by their length and by a part of the word that edits leave whole: of three thirds, two edits
    change two at most.
    """
    def third(c: Column, i: int) -> Column:
        n = F.length(c)
        a = (n * i / 3).cast("int")
        return F.substring(c, a + 1, (n * (i + 1) / 3).cast("int") - a)

    w = asked.select("word").distinct().withColumn("most", F.when(F.length("word") <= 2, 0).when(F.length("word") <= 5, 1).otherwise(2))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), third(F.col("word"), i).alias("part")) for i in range(3)])
    w = w.select("word", "most", F.explode(keys).alias("k")).select("word", "most", F.col("k.i").alias("i"), F.col("k.part").alias("part"))
    # a part of the word stands in the term at most two places from its own
    pieces = []
    for i in range(3):
        for d in range(-2, 3):
            for grow in range(-2, 3):
                n = F.length("term") + grow
                a = (n * i / 3).cast("int")
                size = (n * (i + 1) / 3).cast("int") - a
                pieces.append(F.when((n > 0) & (a + d >= 0), F.struct(F.lit(i).alias("i"), F.substring("term", a + d + 1, size).alias("part"))))
    t = terms.select("term").distinct().select("term", F.explode(F.array_distinct(F.array_compact(F.array(*pieces)))).alias("k"))
    met = t.select("term", F.col("k.i").alias("i"), F.col("k.part").alias("part")).join(bounded(w), ["i", "part"])
    met = met.where(F.abs(F.length("term") - F.length("word")) <= F.col("most")).select("word", "term", "most").distinct()
    return met.withColumn("distance", F.levenshtein("word", "term").cast("long")).where("distance <= most").select("word", "term", "distance")


def quality_flags(query: Column, least: int = 2, most: int = 200) -> Column:
    """Whether a question is worth a text search: of so many characters and with a letter or digit."""
    t = F.trim(query)
    return F.length(t).between(least, most) & t.rlike(r"[\p{L}\p{N}]")


def cleaned_query(query: Column, most: int = 200) -> Column:
    """White space as single spaces, cut to the engine's longest query."""
    return F.substring(F.trim(F.regexp_replace(query, r"\s+", " ")), 1, most)


def runs(hits: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_ids): each query's k best in order."""
    few = hits.where(F.col("rank") <= k)
    return few.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
