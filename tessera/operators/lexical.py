"""Term statistics, BM25, sparse vectors, phrase mining and vocabulary coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import char_grams, marked_tokens, tokens
from ..session import bounded, cut


#: A function from a text column to its tokens; ``functions.segment.segment`` gives one for running CJK text.
Tokenizer = Callable[[Column], Column]


#: What stands between a text's tokens on their way to Python: one string goes there many times faster than its tokens.
MARK = "\x1f"


def packed(text: Column, tokenizer: Tokenizer = tokens) -> Column:
    """A text's tokens as one string; the usual ones are marked off by one replacement, without an array."""
    return marked_tokens(text, MARK) if tokenizer is tokens else F.array_join(tokenizer(text), MARK)


def holding_tokens(batch: pa.RecordBatch, column: str = "t") -> pa.RecordBatch:
    """The rows with tokens. Left to the tasks: a condition on tokens would have Spark find them twice."""
    return batch.filter(pc.fill_null(pc.not_equal(batch.column(column), ""), False))


def unpacked(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of tokens of each ``packed`` text, none of which is empty, and all tokens."""
    parts = pc.split_pattern(column, MARK)
    return pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(parts)


def different(numbers: np.ndarray) -> np.ndarray:
    """The different ones, in order, by sorting: ``np.unique`` hashes them, which takes many times longer."""
    by = np.sort(numbers)
    return by[np.concatenate([[True], by[1:] != by[:-1]])] if len(by) else by


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str = "tf", tokenizer: Tokenizer = tokens) -> DataFrame:
    """(key, term, count): partial sums combine before the shuffle."""
    return docs.select(key, F.explode(tokenizer(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias(count))


def corpus(docs: DataFrame, text: str = "text", tokenizer: Tokenizer = tokens) -> DataFrame:
    """(term, df, freq): a written table from one scan and one shuffle of the terms of each batch of documents.

    The row without a term holds the documents that have tokens (df) and their tokens (freq). A row of docs is a document.
    """
    bag = docs.select(packed(F.col(text), tokenizer).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(holding_tokens, batches):
            if not len(batch):
                continue
            n, flat = unpacked(batch.column("t"))
            coded = pc.dictionary_encode(flat)
            code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            once = different(np.repeat(np.arange(len(n)), n) * size + code) % size
            df, freq = np.bincount(once, minlength=size), np.bincount(code, minlength=size)
            whole = pa.record_batch([pa.array([None], pa.string()), pa.array([len(n)]), pa.array([len(code)])], names=["term", "df", "freq"])
            yield from (pa.record_batch([coded.dictionary.cast(pa.string()), pa.array(df), pa.array(freq)], names=["term", "df", "freq"]), whole)

    rows = bag.mapInArrow(count, "term string, df long, freq long")
    return cut(rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("freq").alias("freq")))


def forced_terms(stats: DataFrame, terms: DataFrame) -> DataFrame:
    """``corpus`` with those of the terms (term) that no document has as the words of one document more."""
    terms = terms.select("term").where("term is not null").distinct()
    have = stats.join(bounded(terms), "term", "left_semi").select("term")
    missing = cut(terms.join(have, "term", "left_anti"))
    n = missing.count()
    if not n:
        return stats
    whole = stats.where("term is null").agg(F.coalesce(F.max("df"), F.lit(0)) + 1, F.coalesce(F.max("freq"), F.lit(0)) + n).first()
    more = missing.select("term", F.lit(1).cast("long").alias("df"), F.lit(1).cast("long").alias("freq"))
    return stats.where("term is not null").unionByName(more).unionByName(stats.sparkSession.createDataFrame([(None, *whole)], "term string, df long, freq long"))


def corpus_size(stats: DataFrame) -> DataFrame:
    """One row (n, avgdl) of ``corpus``: documents with tokens and their mean length."""
    return stats.where("term is null").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n"), (F.max("freq") / F.max("df")).alias("avgdl"))


def term_stats(stats: DataFrame, variant: str = "okapi") -> DataFrame:
    """(term, df, idf) of ``corpus``. okapi: negative idf becomes a quarter of the mean over all terms; lucene: ln(1 + ...)."""
    df = stats.where("term is not null").join(F.broadcast(corpus_size(stats).select("n")))
    if variant == "lucene":
        return df.select("term", "df", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    raw = df.select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _tf(docs: DataFrame, tokenizer: Tokenizer, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, dl, term, tf); of ``terms`` only, if given, before anything is shuffled."""
    bag = docs.select("doc_id", tokenizer(F.col("text")).alias("t")).where(F.size("t") > 0)
    rows = bag.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    rows = rows if terms is None else rows.join(bounded(terms), "term", "left_semi")
    return rows.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def saturation(k1: float, b: float) -> Column:
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def weights(docs: DataFrame, variant: str = "okapi", k1: float = 1.5, b: float = 0.75, stats: DataFrame | None = None, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(doc_id, term, weight): the BM25 weight of each term, the sparse vectors in long form."""
    stats = corpus(docs, tokenizer=tokenizer) if stats is None else stats
    base = _tf(docs, tokenizer).join(term_stats(stats, variant), "term").join(F.broadcast(corpus_size(stats).select("avgdl")))
    return base.select("doc_id", "term", (F.col("idf") * saturation(k1, b)).alias("weight"))


def top_k(scored: DataFrame, k: int, key: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of each key, with their rank; equal scores go by id."""
    order = W.partitionBy(key).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_scores(docs: DataFrame, queries: DataFrame, variant: str = "okapi", k1: float = 1.5, b: float = 0.75, stats: DataFrame | None = None, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(query_id, doc_id, score): documents are scanned once for ``stats`` and once for the terms of the queries."""
    stats = corpus(docs, tokenizer=tokenizer) if stats is None else stats
    q = cut(term_counts(queries, "query_id", "text", "qtf", tokenizer).join(term_stats(stats, variant), "term"))
    hits = _tf(docs, tokenizer, q.select("term").distinct()).join(bounded(q), "term").join(F.broadcast(corpus_size(stats).select("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * saturation(k1, b)), 6).alias("score"))


def sparse_top_terms(w: DataFrame, k: int = 10) -> DataFrame:
    """Each document's k heaviest terms, divided by its heaviest: (doc_id, term, weight, rank)."""
    each = W.partitionBy("doc_id")
    scaled = w.where("weight > 0").withColumn("weight", F.round(F.col("weight") / F.max("weight").over(each), 6))
    return top_k(scaled, k, "doc_id", "weight", "term")


def sparse_dot(index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Documents of a stored index, or of a corpus that is scanned, by the inner product of their sparse vectors with the query's (same weights, both sides)."""
    q = weights(queries.withColumnRenamed("query_id", "doc_id")).where("weight > 0").withColumnRenamed("doc_id", "query_id")
    known = index.stats("okapi").where("idf > 0").join(bounded(q.select("term").distinct()), "term", "left_semi")
    return index.best(q.join(known, "term").select("query_id", "term", (F.col("weight") * F.col("idf")).alias("factor")), k)


def _runs(n: int) -> Column:
    at = F.sequence(F.lit(1), F.size("t") - (n - 1))
    return F.when(F.size("t") >= n, F.transform(at, lambda i: F.array_join(F.slice("t", i, n), " "))).otherwise(F.array().cast("array<string>"))


def ngrams(docs: DataFrame, *n: int) -> DataFrame:
    """(gram, freq, df) of runs of n tokens, of several lengths together: one scan and one shuffle of partial sums.

    Runs are built and sorted within a document's row, so that the first of equal ones counts for the document.
    """
    t = docs.select(tokens(F.col("text")).alias("t")).select(F.sort_array(F.concat(*[_runs(i) for i in n])).alias("runs"))
    first = lambda g, i: F.coalesce(F.get("runs", i - 1) != g, F.lit(True)).cast("int")
    rows = t.select(F.explode(F.transform("runs", lambda g, i: F.struct(g.alias("gram"), first(g, i).alias("d")))).alias("x")).select("x.*")
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"), F.sum("d").alias("df"))


def near_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(phrase, documents, times) of pairs (a, b) of tokens, ``a b`` as a phrase: places of a from which b is the next token or the one after, and the
    documents that have one.

    Each place goes to Python as a number; the pairs, which are a bounded table, go to the tasks, and a row a batch of documents and pair comes back.
    """
    asked = pairs.select("a", "b").distinct().toArrow().combine_chunks()
    names = pc.unique(pa.chunked_array([asked.column("a").combine_chunks(), asked.column("b").combine_chunks()]).combine_chunks())
    a, b = (pc.index_in(asked.column(c).combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    key = a * len(names) + b
    by = np.argsort(key)
    text = pc.binary_join_element_wise(asked.column("a"), asked.column("b"), " ").combine_chunks().take(pa.array(by))
    sent = docs.sparkSession.sparkContext.broadcast((names, key[by], text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, text = sent.value
        for batch in map(holding_tokens, batches):
            n, flat = unpacked(batch.column("t"))
            code = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, found = np.repeat(np.arange(len(n)), n), []
            for gap in (1, 2):
                x, y = code[:-gap], code[gap:]
                made = x * len(names) + y
                at = np.searchsorted(key, made)
                held = (x >= 0) & (y >= 0) & (row[:-gap] == row[gap:]) & (key[np.minimum(at, len(key) - 1)] == made)
                found.append(np.flatnonzero(held) * len(key) + at[held])
            # a place that makes a pair by both gaps counts once
            both = different(np.concatenate(found))
            place, pair = both // len(key), both % len(key)
            times = np.bincount(pair, minlength=len(key))
            documents = np.bincount(different(row[place] * len(key) + pair) % len(key), minlength=len(key))
            some = np.flatnonzero(times)
            yield pa.record_batch([text.take(pa.array(some)), pa.array(documents[some]), pa.array(times[some])], names=["phrase", "documents", "times"])

    schema = "phrase string, documents long, times long"
    if not len(key):
        return docs.sparkSession.createDataFrame([], schema)
    return docs.select(packed(F.col("text")).alias("t")).mapInArrow(count, schema).groupBy("phrase").agg(F.sum("documents").alias("documents"), F.sum("times").alias("times"))


def pmi_phrases(docs: DataFrame, min_freq: int = 5, min_pmi: float = 3.0, least: int = 0, most: int = 0) -> DataFrame:
    """(phrase, freq, df, pmi) of token pairs: ln(p12 / (p1 p2) + 1e-10); of ``least`` to ``most`` characters if given."""
    every, seen = ngrams(docs, 1, 2).withColumn("pair", F.col("gram").contains(" ")), Observation()
    every = every.observe(seen, F.sum(F.when(~F.col("pair"), F.col("freq"))).alias("n1"), F.sum(F.when(F.col("pair"), F.col("freq"))).alias("n2"))
    # rare pairs are seen for the totals and not written
    both = cut(every.where(~F.col("pair") | (F.col("freq") >= min_freq)))
    n1, n2 = (F.lit(seen.get[n]).cast("double") for n in ("n1", "n2"))
    one, pairs = both.where("not pair").select("gram", "freq"), both.where("pair")
    if most:
        pairs = pairs.where(F.length(F.replace("gram", F.lit(" "), F.lit(""))).between(least, most))
    pairs = pairs.withColumns({"a": F.split("gram", " ")[0], "b": F.split("gram", " ")[1]})
    pairs = pairs.join(one.select(F.col("gram").alias("a"), F.col("freq").alias("fa")), "a").join(one.select(F.col("gram").alias("b"), F.col("freq").alias("fb")), "b")
    pmi = F.ln((F.col("freq") / n2) / ((F.col("fa") / n1) * (F.col("fb") / n1)) + 1e-10)
    return pairs.select(F.col("gram").alias("phrase"), "freq", "df", F.round(pmi, 6).alias("pmi")).where(F.col("pmi") >= min_pmi)


def phrase_weights(phrases: DataFrame, docs: int | Column, low: Column, mid: Column, min_pmi: float = 3.0) -> DataFrame:
    """idf (1 + boost): df 1 +.2, up to mid +.1, up to low 0, else -.5; and -.5 below the PMI threshold."""
    idf = F.ln((docs + 1) / (F.col("df") + 1)) + 1
    boost = F.when(F.col("df") == 1, 0.2).when(F.col("df") <= mid, 0.1).when(F.col("df") <= low, 0.0).otherwise(-0.5)
    boost = boost + F.when(F.col("pmi") < min_pmi, -0.5).otherwise(0.0)
    return phrases.withColumn("weight", F.round(idf * (1 + boost), 6))


def auto_thresholds(phrases: DataFrame) -> DataFrame:
    """One row (mid, low): the 10th and 33rd percentile of document frequency, cut to integers."""
    p = F.percentile("df", F.array(F.lit(0.1), F.lit(0.33)))
    return phrases.agg(p.alias("p")).select(F.col("p")[0].cast("long").alias("mid"), F.col("p")[1].cast("long").alias("low"))


def coverage(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: tokens, distinct tokens, covered ones, and the rate of unknown tokens."""
    t = texts.select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    known = t.join(vocab.select("term").distinct().withColumn("known", F.lit(1)), "term", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    return known.agg(
        F.sum("c").alias("total_tokens"), F.count(F.lit(1)).alias("unique_tokens"), F.sum("known").alias("covered_unique"), F.sum(F.col("known") * F.col("c")).alias("covered_tokens"),
        F.round(1 - F.sum(F.col("known") * F.col("c")) / F.sum("c"), 6).alias("oov_rate"), F.round(F.sum("known") / F.count(F.lit(1)), 6).alias("coverage"),
    )


def char_tfidf(docs: DataFrame, most: int = 2000, max_df: float = 0.8) -> DataFrame:
    """(doc_id, gram, weight) of character n-grams of 1 to 3: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), unit length a document.

    Grams in more than ``max_df`` of the documents are left out; of the others the ``most`` frequent count.
    """
    tf = docs.select("doc_id", F.explode(char_grams(F.col("text"))).alias("gram")).groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    stats = tf.groupBy("gram").agg(F.sum("tf").alias("freq"), F.count(F.lit(1)).alias("df")).join(F.broadcast(n))
    kept = stats.where(F.col("df") <= max_df * F.col("n")).orderBy(F.desc("freq"), "gram").limit(most)
    idf = F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1
    raw = tf.join(F.broadcast(kept.select("gram", idf.alias("idf"))), "gram").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    return raw.select("doc_id", "gram", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id"))), 6).alias("weight"))
