"""The whole dictionary job: phrases, their document frequency and weight, the whitelist, and the vocabulary of an index that knows it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded, cut
from . import lexical
from .scan import Corpus
from .textindex import TextIndex

#: Phrases whose automaton a task holds.
MOST_PHRASES = 1_000_000


def containment(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, df): how many documents (text) hold each phrase as a part of their text; phrases that none holds have 0.

    One automaton over all phrases reads each text once; counts of a task are added up before the shuffle.
    """
    import ahocorasick

    known = [r[0] for r in phrases.select("phrase").where("phrase <> ''").distinct().limit(MOST_PHRASES + 1).collect()]
    if len(known) > MOST_PHRASES:
        raise ValueError(f"a dictionary job takes at most {MOST_PHRASES} phrases")
    sent = docs.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("array<int>")
    def held(text: pa.Array) -> pa.Array:
        machine = ahocorasick.Automaton()
        for i, p in enumerate(sent.value):
            machine.add_word(p, i)
        if len(machine):
            machine.make_automaton()
        return pa.array([sorted({i for _, i in machine.iter(t)}) if t and len(machine) else [] for t in text.to_pylist()], pa.list_(pa.int32()))

    counts = docs.select(F.explode(held("text")).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("df"))
    names = docs.sparkSession.createDataFrame(list(enumerate(known)), "i int, phrase string")
    return names.join(counts, "i", "left").select("phrase", F.coalesce("df", F.lit(0)).alias("df"))


def build(docs: DataFrame, path: str, domain: DataFrame | None = None, min_freq: int = 5, min_pmi: float = 3.0) -> tuple[DataFrame, TextIndex]:
    """The dictionary (term, weight, freq, df) of documents (doc_id, text), and the index at the path that counts them.

    Auto phrases are pairs by PMI; the whitelist adds domain terms (term), and those that no document has become the index's virtual document. A
    term's weight is its idf raised or lowered by its document frequency as a phrase, with thresholds from the phrases' own frequencies, and lowered
    once more where its PMI is small; terms that are no phrase count as in one document, as phrases do that no text holds.
    """
    index = TextIndex.create(docs.sparkSession, path)
    index.add(docs)
    if domain is not None:
        index.force_terms([r[0] for r in domain.select(F.lower("term")).distinct().collect()])
    return _weighted(docs, index.stats().join(index.terms().select("term", "freq"), "term"), min_freq, min_pmi), index


def words(docs: DataFrame, domain: DataFrame | None = None, min_freq: int = 5, min_pmi: float = 3.0) -> DataFrame:
    """The dictionary of ``build`` by scans: no index is written, and words and pairs with their counts are all that is shuffled."""
    counts = Corpus(docs).corpus()
    if domain is not None:
        counts = lexical.forced_terms(counts, domain.select(F.lower("term").alias("term")))
    return _weighted(docs, lexical.term_stats(counts).join(counts.select("term", "freq"), "term"), min_freq, min_pmi)


def _weighted(docs: DataFrame, terms: DataFrame, min_freq: int, min_pmi: float) -> DataFrame:
    """(term, weight, freq, df) of terms (term, idf, freq), by the phrases of the documents."""
    phrases = cut(lexical.pmi_phrases(docs, min_freq, min_pmi).select("phrase", "pmi", "df"))
    low = lexical.auto_thresholds(phrases)
    terms = terms.select("term", "idf", "freq")
    known = bounded(phrases.withColumnRenamed("phrase", "term").withColumnRenamed("df", "phrase_df"))
    each = terms.join(known, "term", "left").join(F.broadcast(low)).withColumn("df", F.coalesce("phrase_df", F.lit(1)))
    boost = F.when(F.col("df") == 1, 0.2).when(F.col("df") <= F.col("mid"), 0.1).when(F.col("df") <= F.col("low"), 0.0).otherwise(-0.5)
    boost = boost + F.when(F.col("pmi") < min_pmi, -0.5).otherwise(0.0)
    return each.select("term", F.round(F.col("idf") * (1 + F.coalesce(boost, F.lit(0.2))), 6).alias("weight"), "freq", "df")
