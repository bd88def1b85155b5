"""Language identification of mixed-language text: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters. The script of most of its letters narrows the candidates to the languages that are
written in it (those with at least ``SCRIPT_SHARE`` of their letters in the script). For these, a word scores the
log-probabilities of the character trigrams centred on its letters. The best sequence of languages, where every change from one word to the
next costs ``SWITCH``, labels spans; a document's language is the one with most letters, its score their share.

Trigram counts are gathered on the executors from a bounded sample of labelled documents (``sample`` of each of the ``MAX_LANGS`` most frequent
languages, about, chosen by a seeded hash), whole texts each. The bound keeps the model's size from growing with a dirty label column.

Rows: a null text or one without a letter is ``und`` with score 0; a word whose script no language is written in
weighs nothing, and a text of only such words gets the most frequent language with score 0. Ties go to the language
first in code-point order. Long texts are read whole; repeated rows are judged alike; an empty table gives an empty one. Without
training rows everything is ``und``. Columns named ``lang_pred`` or ``score`` are
replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import batches, sample_by_group
from .hashing import chunks
from .store import crc_mod, free_name, lean_workers, replace_columns

BITS = 16
SAMPLE = 1500
#: Languages of a model at most; a language number fits in a byte.
MAX_LANGS = 256
SWITCH = 8.0
SCRIPT_SHARE = 0.01
GROUP = 2_000_000
_NEVER = np.float32(-1e4)

# First and last code point of the scripts' main blocks, as in the Unicode standard.
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
SCRIPTS = list(dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its script (the last number: none of the ranges)."""
    letter = np.array([chr(i).isalpha() for i in range(0x110000)])
    script = np.full(0x110000, len(SCRIPTS), np.uint8)
    for name, a, b in SCRIPT_RANGES:
        script[a : b + 1] = SCRIPTS.index(name)
    return letter, script


def _parse(c: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Positions of letters, their trigram buckets and scripts; first letter of each word; bounds of texts' words."""
    letter, script = _letters()
    is_letter = letter[c]
    x = np.where(is_letter, c, 0).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    h = x[at - 1] * np.uint32(2654435761) + x[at] * np.uint32(2246822519) + x[at + 1] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    bucket = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
    new = np.flatnonzero(~is_letter[at - 1])
    return at, bucket, script[c[at]], new, np.searchsorted(at[new], starts)


@dataclass
class Model:
    """langs in code-point order; log-probabilities of buckets by language; which languages each script allows."""

    langs: list[str]
    table: np.ndarray
    allowed: np.ndarray
    common: int
    switch: float = SWITCH

    def spans(self, col: pa.Array) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
        """(row, [(language, words, letters)]) of the labelled spans of each text, in order."""
        labels, letters, bounds, _ = self._labels(col)
        for r in range(len(col)):
            part, out = slice(bounds[r], bounds[r + 1]), []
            for lab, n in zip(labels[part], letters[part], strict=True):
                if out and out[-1][0] == self.langs[lab]:
                    out[-1] = (out[-1][0], out[-1][1] + 1, out[-1][2] + int(n))
                else:
                    out.append((self.langs[lab], 1, int(n)))
            yield r, out

    def _labels(self, col: pa.Array):
        k = len(self.langs)
        scores, letters, counts, known = [], [], [], []
        for _, c, starts in batches(col, lower=True):
            at, bucket, script, new, bounds = _parse(c, starts)
            counts.append(np.diff(bounds))
            if not len(new):
                continue
            s = np.add.reduceat(self.table[bucket], new, axis=0)
            n = np.diff(np.append(new, len(at)))
            main = script[new + n // 2]
            allow = self.allowed[main]
            some = allow.any(axis=1)
            s[~allow] = _NEVER
            s[~some] = 0
            scores.append(s)
            letters.append(n)
            known.append(some)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        s = np.concatenate(scores) if scores else np.zeros((0, k), np.float32)
        n = np.concatenate(letters) if letters else np.zeros(0, np.int64)
        known = np.concatenate(known) if known else np.zeros(0, bool)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return viterbi(s, counts, self.switch), n, bounds, known

    def predict(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: und) and score of each text.

        Texts of like length go together, in groups of at most GROUP characters or one text, which bounds memory and steps.
        """
        lang, score = np.full(len(col), -1), np.zeros(len(col))
        if self.langs:
            size = np.asarray(pc.fill_null(pc.utf8_length(col), 0)).astype(np.int64)
            order = np.argsort(size, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(size[order])])
            for i, j in chunks(bounds, GROUP):
                rows = order[i:j]
                lang[rows], score[rows] = self._predict(col.take(pa.array(rows)))
        return lang, score

    def _predict(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        k, rows = len(self.langs), len(col)
        labels, n, bounds, known = self._labels(col)
        row = np.repeat(np.arange(rows), np.diff(bounds))
        total = np.bincount(row, weights=n, minlength=rows)
        by = np.bincount(row * k + labels, weights=n * known, minlength=rows * k).reshape(rows, k)
        lang, most = by.argmax(axis=1), by.max(axis=1)
        lang = np.where(most > 0, lang, np.where(total > 0, self.common, -1))
        return lang, np.where(total > 0, most / np.maximum(total, 1), 0.0)


def viterbi(s: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word, all texts in step: word t of all texts that have one at a time."""
    if not len(s):
        return np.zeros(0, np.int64)
    k, rows = s.shape[1], np.argsort(-counts, kind="stable")
    size = counts[rows]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")
    base = np.concatenate([[0], np.cumsum(active)])
    rank = np.empty(len(counts), np.int64)
    rank[rows] = np.arange(len(counts))
    bounds = np.cumsum(counts) - counts
    pos = np.arange(len(s)) - np.repeat(bounds, counts)
    dest = base[pos] + np.repeat(rank, counts)
    packed = np.empty_like(s)
    packed[dest] = s
    back = np.empty((len(s), k), np.uint8)
    own = np.arange(k, dtype=np.uint8)
    v = np.zeros((len(counts), k), np.float32)
    end = np.zeros(len(counts), np.int64)
    for t in range(size[0]):
        a = active[t]
        if t:
            if a < active[t - 1]:
                end[a : active[t - 1]] = v[a : active[t - 1]].argmax(axis=1)
            v = v[:a]
            best = v.argmax(axis=1)
            cost = v[np.arange(a), best][:, None] - np.float32(switch)
            stay = v >= cost
            back[base[t] : base[t] + a] = np.where(stay, own, best[:, None])
            v = np.where(stay, v, cost)
        else:
            v = v[:a]
        v = v + packed[base[t] : base[t] + a]
        v -= v.max(axis=1, keepdims=True)
    end[: len(v)] = v.argmax(axis=1)
    out = np.empty(len(s), np.int64)
    for t in range(size[0] - 1, -1, -1):
        a = active[t]
        out[base[t] : base[t] + a] = end[:a]
        if t:
            end[:a] = back[np.arange(base[t], base[t] + a), end[:a]]
    return out[dest]


def _count(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): trigram buckets (kind 0) and scripts (kind 1) of each language."""
    for batch in batches_:
        langs = batch.column(0).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), np.asarray(langs.indices)
        grams = np.zeros((len(names), 1 << BITS), np.int64)
        scripts = np.zeros((len(names), len(SCRIPTS) + 1), np.int64)
        for i, c, starts in batches(batch.column(1), lower=True):
            at, bucket, script, _, _ = _parse(c, starts)
            lang = code[i + np.searchsorted(starts, at, side="right") - 1]
            grams += np.bincount(lang * (1 << BITS) + bucket, minlength=grams.size).reshape(grams.shape)
            scripts += np.bincount(lang * scripts.shape[1] + script, minlength=scripts.size).reshape(scripts.shape)
        for kind, table in ((0, grams), (1, scripts)):
            a, b = np.nonzero(table)
            yield pa.record_batch([pa.array([names[x] for x in a], pa.string()), pa.array(np.full(len(a), kind, np.int32)), pa.array(b.astype(np.int32)), pa.array(table[a, b])], names=["lang", "kind", "key", "n"])


def fit(docs: DataFrame, fold: tuple[int, int] | None = (4, 2), sample: int = SAMPLE, seed: int = 23, switch: float = SWITCH) -> Model:
    """A model from text and lang of documents outside the fold (crc32(doc_id) mod fold[0] is fold[1])."""
    lean_workers(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.where("lang is not null and text is not null and doc_id is not null")
    if fold:
        d = d.where(crc_mod(F.col("doc_id"), fold[0]) != fold[1])
    counts = sample_by_group(d, "lang", "doc_id", sample, seed, MAX_LANGS).select("lang", "text").mapInArrow(_count, "lang string, kind int, key int, n long")
    got = counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toArrow()
    name = got.column("lang").to_pylist()
    langs = sorted(set(name))
    kind, key, n = (got.column(x).to_numpy() for x in ("kind", "key", "n"))
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in name], np.int64)
    grams, scripts = np.zeros((len(langs), 1 << BITS)), np.zeros((len(langs), len(SCRIPTS) + 1))
    grams[lang[kind == 0], key[kind == 0]] = n[kind == 0]
    scripts[lang[kind == 1], key[kind == 1]] = n[kind == 1]
    table = np.log((grams + 0.1) / (grams.sum(axis=1, keepdims=True) + 0.1 * (1 << BITS)))
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(langs, np.ascontiguousarray(table.T.astype(np.float32)), (share >= SCRIPT_SHARE).T.copy(), int(grams.sum(axis=1).argmax()) if langs else 0, switch)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(text: pa.Array) -> pa.Array:
        m = sent.value
        lang, score = m.predict(text)
        names = pa.array([*m.langs, "und"], pa.string()).take(pa.array(np.where(lang < 0, len(m.langs), lang)))
        return pa.StructArray.from_arrays([names, pa.array(score)], names=["lang_pred", "score"])

    r = free_name(docs, "language")
    with_r = docs.withColumn(r, predict(F.col("text").cast("string")))
    return replace_columns(with_r, {"lang_pred": F.col(f"{r}.lang_pred"), "score": F.col(f"{r}.score")}).drop(r)


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans): each document's spans in order, with language, words and letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<lang string, words int, letters int>>")
    def spans(text: pa.Array) -> pa.Array:
        rows = [[{"lang": a, "words": b, "letters": c} for a, b, c in s] for _, s in sent.value.spans(text)]
        return pa.array(rows, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32()), ("letters", pa.int32())])))

    return docs.select("doc_id", spans(F.col("text").cast("string")).alias("spans"))
