"""Search of a batch of queries in one scan of the documents, without an index.

A batch of queries is small beside the documents, so it goes to the tasks, which score each document as they read it and keep each query's k best.
Only those are shuffled: k rows a query and task, however long the queries and frequent their terms. Statistics are counted in one scan more, whose
partial sums combine first. So work grows with the text, and what is shuffled with the vocabulary; ``textindex`` is for queries that come one at a time.

Rows: null, empty and token-free texts and null ids are no documents; of rows with one id the one with the smallest text is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import bounded, cut
from . import lexical
from .lexical import MARK, Tokenizer, packed, term_counts, top_k, unpacked
from .ranking import PRODUCTS, Best

#: Rows (query, term) that are sent to the tasks at a time; more queries are more scans.
MOST_FACTORS = 1 << 20
#: Characters of phrases whose automaton a task holds; more are more scans.
MOST_CHARACTERS = 2 << 20
_HITS, _PLACES = "query_id long, doc_id long, score double, rank int", "query_id long, doc_id long, times long"


def one_each(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text), one row each; texts are compared for repeated ids only."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    again = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return rows
    again = bounded(again)
    once = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.join(again, "doc_id", "left_anti").unionByName(once)


class Corpus:
    """Documents (doc_id, text) that are searched by scans; their statistics are counted once."""

    def __init__(self, docs: DataFrame, tokenizer: Tokenizer = tokens) -> None:
        self.docs, self.tokenizer = one_each(docs), tokenizer
        self._counts: DataFrame | None = None

    def corpus(self) -> DataFrame:
        """(term, df, freq), and the row without a term, as ``lexical.corpus`` has them."""
        if self._counts is None:
            self._counts = lexical.corpus(self.docs, tokenizer=self.tokenizer)
        return self._counts

    def terms(self) -> DataFrame:
        """(term, df, freq) of the vocabulary."""
        return self.corpus().where("term is not null")

    def stats(self, variant: str = "okapi") -> DataFrame:
        """(term, df, idf) of the vocabulary."""
        return lexical.term_stats(self.corpus(), variant)

    def search(self, queries: DataFrame, k: int = 10, variant: str = "okapi", k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """The k best documents of each query (query_id, text) by BM25: (query_id, doc_id, score, rank)."""
        asked = cut(term_counts(queries, "query_id", "text", "qtf", self.tokenizer))
        known = self.stats(variant).join(bounded(asked.select("term").distinct()), "term", "left_semi")
        return self.best(asked.join(known, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("factor")), k, k1, b)

    def best(self, factors: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """The k best by the sum of factor times saturated frequency over (query_id, term, factor), one row for each term of a query."""
        factors = cut(factors.select(F.col("query_id").cast("long").alias("query_id"), "term", "factor"))
        avgdl = lexical.corpus_size(self.corpus()).first().avgdl
        bags = self.docs.select("doc_id", packed(F.col("text"), self.tokenizer).alias("t"))
        blocks = -(-factors.count() // MOST_FACTORS)
        parts = []
        for i in range(blocks):
            block = factors if blocks == 1 else factors.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
            parts.append(top_k(scored(bags, block.toArrow(), k, avgdl, k1, b), k))
        # hits are few and used again and again, so they are written
        return cut(reduce(DataFrame.unionAll, parts)) if parts else self.docs.sparkSession.createDataFrame([], _HITS)


def by_term(asked: pa.Table, value: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, where each one's rows begin, the rows' queries by number, their values, the queries' ids) of rows (query_id, term, value)."""
    names = pc.unique(asked.column("term").combine_chunks())
    code = pc.index_in(asked.column("term").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
    ids, of = np.unique(asked.column("query_id").to_numpy(), return_inverse=True)
    by = np.argsort(code, kind="stable")
    return names, np.searchsorted(code[by], np.arange(len(names) + 1)), of[by], asked.column(value).to_numpy()[by], ids


def known(packed_: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each row; rows, terms by number and times of those among ``names``, by row) of ``packed`` texts."""
    held = np.flatnonzero(pc.fill_null(pc.not_equal(packed_, ""), False).to_numpy(zero_copy_only=False))
    n, flat = unpacked(packed_.take(pa.array(held)))
    size = np.zeros(len(packed_), np.int64)
    size[held] = n
    term = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(held, n)
    both, times = np.unique(row[term >= 0] * len(names) + term[term >= 0], return_counts=True)
    return size, both // max(1, len(names)), both % max(1, len(names)), times


def spread(first: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in term, rows of ``by_term``): each term with each of its rows."""
    n = first[term + 1] - first[term]
    return np.repeat(np.arange(len(term)), n), np.repeat(first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())


def pieces(load: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose load is about ``PRODUCTS`` in all and which are so many at most.

    They are few at first, as the scores that they reach keep most of the others out.
    """
    until, lo, step = np.concatenate([[0], np.cumsum(load)]), 0, min(64, rows)
    while lo < len(load):
        hi = max(lo + 1, min(lo + step, int(np.searchsorted(until, until[lo] + PRODUCTS, "right")) - 1))
        yield lo, hi
        lo, step = hi, min(4 * step, rows)


def scored(bags: DataFrame, factors: pa.Table, k: int, avgdl: float, k1: float, b: float) -> DataFrame:
    """(query_id, doc_id, score): the k best of each task's documents (doc_id, t) by the sum of factor times saturated frequency.

    t holds the tokens, as an array or ``packed``.
    """
    sent = bags.sparkSession.sparkContext.broadcast(by_term(factors, "factor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, query, factor, ids = sent.value
        best = Best(len(ids), k)
        for batch in batches:
            doc, (dl, row, term, tf) = batch.column("doc_id").to_numpy(), known(batch.column("t"), names)
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
            load = np.bincount(row, first[term + 1] - first[term], len(doc))
            for lo, hi in pieces(load, max(1, PRODUCTS // max(1, len(ids)))):
                i, j = np.searchsorted(row, (lo, hi))
                of, at = spread(first, term[i:j])
                cell = (row[i:j][of] - lo) * len(ids) + query[at]
                total = np.bincount(cell, part[i:j][of] * factor[at], (hi - lo) * len(ids))
                met = np.flatnonzero(np.bincount(cell, minlength=len(total)))
                q, score = met % len(ids), np.round(total[met], 6)
                near = score >= best.least[q]
                best.add(q[near], doc[lo + met[near] // len(ids)], score[near])
        q, found, score = best.rows()
        yield pa.record_batch([pa.array(ids[q]), pa.array(found), pa.array(score)], names=["query_id", "doc_id", "score"])

    t = F.col("t") if dict(bags.dtypes)["t"] == "string" else F.array_join("t", MARK)
    return bags.select("doc_id", t.alias("t")).mapInArrow(run, "query_id long, doc_id long, score double")


def phrases(docs: DataFrame, queries: DataFrame, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(query_id, doc_id, times): documents (doc_id, text) that hold the tokens of a query's text (query_id, text) in a row.

    ``times`` counts from the left the places that don't overlap; a query without tokens is in no document. One automaton over the phrases reads
    each text once, and only what it finds leaves the tasks: nothing is shuffled.
    """
    asked = cut(queries.select(F.col("query_id").cast("long").alias("query_id"), packed(F.col("text"), tokenizer).alias("t")).where("t <> ''"))
    blocks = -(-(asked.agg(F.sum(F.length("t") + 2)).first()[0] or 0) // MOST_CHARACTERS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), packed(F.col("text"), tokenizer).alias("t"))
    parts = [_with_phrases(rows, asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)) for i in range(blocks)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], _PLACES)


def _with_phrases(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``phrases`` of rows (doc_id, t) and a bounded table (query_id, t), both ``packed``."""
    by_text: dict[str, list[int | None]] = {}
    for r in asked.collect():
        by_text.setdefault(f"{MARK}{r.t}{MARK}", []).append(r.query_id)
    sent = rows.sparkSession.sparkContext.broadcast(by_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in sent.value:
            machine.add_word(phrase, phrase)
        if len(machine):
            machine.make_automaton()
        for batch in batches:
            found = []
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("t"), strict=True):
                text, times, last = t.as_py(), {}, {}
                # neighbours share a mark
                for end, phrase in machine.iter(f"{MARK}{text}{MARK}") if text and len(machine) else ():
                    if end - len(phrase) + 1 >= last.get(phrase, 0):
                        times[phrase], last[phrase] = times.get(phrase, 0) + 1, end
                found += [(i, doc, n) for phrase, n in times.items() for i in sent.value[phrase]]
            yield pa.record_batch([pa.array([x[n] for x in found], pa.int64()) for n in range(3)], names=["query_id", "doc_id", "times"])

    return rows.mapInArrow(run, _PLACES)


def verbatim(docs: DataFrame, passages: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(query_id, doc_id) of documents that hold a passage (query_id, text) verbatim; an empty passage stands in every text.

    One automaton over the passages, which are ``most`` at most, reads each text once.
    """
    asked = passages.select("query_id", F.col("text").alias("q")).where("q is not null").distinct().limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} passages")
    sent = docs.sparkSession.sparkContext.broadcast([(r.q, r.query_id) for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for text, i in sent.value:
            by_text.setdefault(text, []).append(i)
        always, machine = by_text.pop("", []), ahocorasick.Automaton()
        for text, same in by_text.items():
            machine.add_word(text, same)
        if by_text:
            machine.make_automaton()
        for batch in batches:
            found = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                held = {i for _, same in machine.iter(text) for i in same} if by_text and text else set()
                found += [(i, doc) for i in (*always, *held)]
            yield pa.record_batch([pa.array([x[n] for x in found], pa.int64()) for n in (0, 1)], names=["query_id", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return rows.mapInArrow(run, "query_id long, doc_id long").distinct()
