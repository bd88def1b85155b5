"""Supervised subword embeddings: a quality classifier over hashed word and character n-grams.

A document is the mean of the learned vectors of its words, word pairs and character 2-, 3- and 4-grams, hashed into a fixed table;
a softmax layer turns the mean into class probabilities. Both are trained on the driver by numpy
stochastic gradient descent over a bounded sample of labelled rows (``sample`` of each class at most, about, chosen by a
seeded hash, and of these, in the order of another hash, as many whole texts as make ``SAMPLE_CHARS`` characters). For scoring, the output layer is folded into the table, so that each n-gram costs one
look-up of its log-odds and whole texts of any length are read.

Rows: null and empty texts have no n-grams and get the output layer's prior; long texts are read whole; repeated rows are scored
alike and an empty table gives an empty one; repeated labels each train; labels that
are null or neither 0 nor 1 are left out. Without labels every score is 0.5; with one class, that class is certain.
Other columns of the input stay; columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .codepoints import PAD, batches, sample_by_group
from .store import Scratch, crc_mod, free_name, give_back, lean_workers, replace_columns

BITS = 18
ORDERS = (2, 3, 4)
SAMPLE = 2000
#: Characters of the training texts that reach the driver at most.
SAMPLE_CHARS = 64 << 20
_MULT = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def _words(c: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space, and the bounds of each text's words."""
    gap = (c == 32) | ((c >= 9) & (c <= 13))
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    first, last = edge[0::2], edge[1::2]
    total = np.cumsum((c * np.uint32(0x01000193)) ^ (c << np.uint32(7)), dtype=np.uint32)
    spread = np.cumsum(c * np.arange(1, len(c) + 1, dtype=np.uint32) * np.uint32(0x9E3779B1), dtype=np.uint32)
    h = total[last - 1] - total[first - 1]
    h2 = spread[last - 1] - spread[first - 1] - first.astype(np.uint32) * np.uint32(0x9E3779B1) * _plain(c, first, last)
    return (h * np.uint32(0x85EBCA6B)) ^ h2, np.searchsorted(first, starts)


def _plain(c: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    s = np.cumsum(c, dtype=np.uint32)
    return s[last - 1] - s[first - 1]


def features(c: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(table entries, bounds of each text's entries) for each kind of n-gram."""
    for n in ORDERS:
        h = np.zeros(len(c) - n + 1, np.uint32)
        for j in range(n):
            h += c[j : j + len(h)] * _MULT[j]
        yield _bucket(h, n), starts - (PAD - 1)
    w, at = _words(c, starts)
    yield _bucket(w, 11), at
    if len(w) > 1:
        n = np.diff(at)
        inside = np.ones(len(w), bool)
        inside[at[1:][n > 0] - 1] = False  # the last word of a text pairs with none
        first = np.flatnonzero(inside)
        yield _bucket(w[first] * np.uint32(0x27D4EB2F) + w[first + 1], 12), np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))])


@dataclass
class Model:
    """Log-odds of class 1 for each table entry, and of the output layer's bias."""

    table: np.ndarray
    bias: float

    def scores(self, col: pa.Array) -> np.ndarray:
        out = np.full(len(col), self.bias)
        for i, c, starts in batches(col):
            total, count = np.zeros(len(starts) - 1), np.zeros(len(starts) - 1)
            some = np.diff(starts) > PAD
            for ids, at in features(c, starts):
                n = np.diff(at)
                run = n > 0
                if run.any():
                    # the segments that hold something, each up to the next such start
                    v = np.add.reduceat(self.table[ids[: at[-1]]].astype(np.float64), at[:-1][run])
                    total[run] += v
                    count[run] += n[run]
            ok = some & (count > 0)
            out[i : i + len(total)][ok] += total[ok] / count[ok]
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 6, rate: float = 4.0, seed: int = 1) -> Model:
    """Fit by stochastic gradient descent, one document a step, with a linearly falling rate."""
    rng = np.random.default_rng(seed)
    if not texts or len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if not texts else (50.0 if labels[0] else -50.0))
    docs = []
    for t in texts:
        for _, c, starts in batches(pa.array([t], pa.string())):
            parts = [ids[at[0] : at[1]] for ids, at in features(c, starts)]
            ids, n = np.unique(np.concatenate(parts), return_counts=True)
            docs.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            ids, share = docs[d]
            rows = emb[ids]
            hidden = share @ rows
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[d]] -= 1
            emb[ids] = rows - (lr * np.sqrt(share))[:, None] * (p @ out)
            out -= (lr / 8) * np.outer(p, hidden)
            bias -= (lr / 80) * p
    w = out[1] - out[0]
    docs.clear()
    give_back()
    return Model((emb @ w).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] | None = (3, 1), sample: int = SAMPLE, seed: int = 17) -> Model:
    """A model from labelled documents outside the fold: rows whose crc32(doc_id) mod fold[0] is fold[1] never train."""
    lean_workers(docs.sparkSession)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if fold:
        y = y.where(crc_mod(F.col("doc_id"), fold[0]) != fold[1])
    y = F.broadcast(sample_by_group(y, "y", "doc_id", sample, seed))
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(y, "doc_id")
    got = Scratch(docs.sparkSession, "quality").cut(got)
    sizes = got.select("doc_id", "y", F.length("text").alias("n"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    fits = sizes.withColumn("total", F.sum("n").over(W.orderBy("h", "doc_id"))).where(F.col("total") <= SAMPLE_CHARS).select("h").distinct()
    got = got.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text")).join(F.broadcast(fits), "h").orderBy("doc_id", "y", "h").select("text", "y").toArrow()
    model = train(got.column("text").to_pylist(), got.column("y").to_pylist())
    del got
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``score`` (probability of class 1) and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def prob(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(text))

    s = free_name(docs, "quality_score")
    with_s = docs.withColumn(s, prob(F.col("text").cast("string")))
    return replace_columns(with_s, {"score": F.col(s), "predicted": (F.col(s) >= 0.5).cast("int")}).drop(s)
