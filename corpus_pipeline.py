"""A cleaning pipeline over documents: language, quality, near duplicates, benchmark passages, source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, mixing, ngram_join, quality
from tessera.llm.store import Scratch, free_name, sized
from tessera.session import table

#: A document stays when its main language holds this share of its letters.
MIN_LANGUAGE_SHARE = 0.5


def _apart(docs: DataFrame, *helpers: str) -> tuple[DataFrame, list]:
    """The documents with columns of the helpers' names renamed, and the columns that give them their names back."""
    names = {c: free_name(docs, f"_own_{c}") if c.lower() in helpers else c for c in docs.columns}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language: no letters, or none that holds half of them."""
    given, own = _apart(docs, "lang_pred", "score")
    found = langid.identify(given, langid.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(*own)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the classifier calls low quality; null and empty texts get the classifier's prior."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    given, own = _apart(docs, "score", "predicted")
    return quality.score(given, model).where("predicted = 1").select(*own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of linked documents (five-word shingles, similarity 0.8 or more).

    Rows of one doc_id are judged each by its own text: one row stays of those in a group, and one of rows with the same
    doc_id and text. Rows without doc_id stay.
    """
    scratch = Scratch(spark, "near-duplicates")
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        found = ngram_join.ngram_jaccard(docs.select("doc_id", "text"), k=5, percent=80)
        gone = scratch.cut(found.where("component_id <> doc_id").select("doc_id"))
        return docs.join(sized(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = ngram_join.ngram_jaccard(keyed.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias(row), "component_id")
    first = keyed.select(row, "doc_id").join(found.where(F.col(row).isNotNull()).distinct(), row).groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first"))
    first = scratch.cut(first.select(F.col("first")[row].alias(row)))
    kept = keyed.join(sized(first, first.count()), row, "left_semi").dropDuplicates([row]).select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that hold a benchmark passage; null and empty texts hold none."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each repetition that the mix takes, with its number and words; texts without words are in none."""
    given, own = _apart(docs.drop("repetition", "words"), "size", "source_size", "target", "whole", "taken")
    return mixing.repeat(mixing.mix(given)).select(*own, "repetition", "words")


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("source_mixing", mix_sources),
]

#: Trained models and word-by-word text scans decide the stages, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
