"""Slot filling: a linear-chain conditional random field, its token features, and BIO labels from slot values."""

from __future__ import annotations

import pickle
from binascii import crc32
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences that training reads at most, by the order of a hash of their id.
MAX_TRAINING_SENTENCES = 5000


def features(tokens: list[str], buckets: int) -> list[list[int]]:
    """Hashed features of each token: itself, affixes, shape, kinds of characters, and the two on each side."""
    out = []
    for i, t in enumerate(tokens):
        form = "".join("X" if c.isupper() else "d" if c.isdigit() else "x" if c.isalpha() else c for c in t)
        names = ["bias", f"w={t.lower()}", f"p={t[:2]}", f"s={t[-2:]}", f"f={form}", f"n={min(len(t), 5)}", f"e={(i == 0) * 2 + (i == len(tokens) - 1)}"]
        for d in (-2, -1, 1, 2):
            j = i + d
            names.append(f"{d}={'<START>' if j < 0 else '<END>' if j >= len(tokens) else tokens[j].lower()}")
        out.append([crc32(n.encode()) % buckets for n in names])
    return out


class Crf:
    """Weights of hashed features by label, and of label pairs."""

    def __init__(self, labels: list[str], buckets: int = 1 << 14) -> None:
        self.labels, self.buckets = labels, buckets
        self.emit, self.step = np.zeros((buckets, len(labels))), np.zeros((len(labels), len(labels)))

    def scores(self, tokens: list[str]) -> tuple[list[list[int]], np.ndarray]:
        f = features(tokens, self.buckets)
        return f, np.array([self.emit[x].sum(axis=0) for x in f]).reshape(len(f), len(self.labels))

    def forward_backward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of labels and of the pairs at each step, and the logarithm of the sum over all paths."""
        n, alpha, beta = len(e), e.copy(), np.zeros_like(e)
        for i in range(1, n):
            alpha[i] += _logsum(alpha[i - 1][:, None] + self.step, 0)
        for i in range(n - 2, -1, -1):
            beta[i] = _logsum(self.step + (e[i + 1] + beta[i + 1])[None, :], 1)
        z = float(_logsum(alpha[-1], 0))
        pairs = np.exp(alpha[:-1, :, None] + self.step[None] + (e[1:] + beta[1:])[:, None, :] - z)
        return np.exp(alpha + beta - z), pairs, z

    def tag(self, tokens: list[str]) -> tuple[list[str], list[float]]:
        """The best path and the marginal of each of its labels."""
        if not tokens:
            return [], []
        _, e = self.scores(tokens)
        best, back = e[0], []
        for i in range(1, len(e)):
            through = best[:, None] + self.step
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + e[i]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        marginal, _, _ = self.forward_backward(e)
        return [self.labels[y] for y in path], [float(marginal[i, y]) for i, y in enumerate(path)]

    def train(self, sentences: list[tuple[list[str], list[str]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-6) -> Crf:
        """AdaGrad on the likelihood of single sentences, in an order of a fixed seed."""
        at = {y: i for i, y in enumerate(self.labels)}
        ge, gs, order = np.full_like(self.emit, 1e-6), np.full_like(self.step, 1e-6), np.random.default_rng(42)
        for _ in range(epochs):
            for k in order.permutation(len(sentences)):
                tokens, labels = sentences[k]
                if not tokens:
                    continue
                f, e = self.scores(tokens)
                y = [at[x] for x in labels]
                one, two, _ = self.forward_backward(e)
                one[range(len(y)), y] -= 1
                pair = two.sum(axis=0)
                np.subtract.at(pair, (y[:-1], y[1:]), 1)
                rows, inverse = np.unique(np.concatenate(f), return_inverse=True)
                g = np.zeros((len(rows), len(self.labels)))
                np.add.at(g, inverse, np.repeat(one, [len(x) for x in f], axis=0))
                g += decay * self.emit[rows]
                ge[rows] += g * g
                self.emit[rows] -= rate * g / np.sqrt(ge[rows])
                gs += pair * pair
                self.step -= rate * pair / np.sqrt(gs)
        return self


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def sentences(seq: DataFrame) -> DataFrame:
    """(sent_id, tokens, labels) from (sent_id, pos, token, label): one row a sentence, in order of pos."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token", "label")))
    return seq.groupBy("sent_id").agg(ordered.alias("x")).select("sent_id", F.col("x.token").alias("tokens"), F.col("x.label").alias("labels"))


def fit(seq: DataFrame, most: int = MAX_TRAINING_SENTENCES, epochs: int = 12) -> Crf:
    """Train on labelled sequences, at most ``most`` of them (those of the smallest hash of their id)."""
    ids = seq.select("sent_id").distinct().orderBy(F.xxhash64("sent_id"), "sent_id").limit(most)
    rows = [(r.tokens, r.labels) for r in sentences(seq.join(ids, "sent_id", "left_semi")).orderBy("sent_id").toLocalIterator()]
    return Crf(sorted({y for _, ys in rows for y in ys} | {"O"})).train(rows, epochs)


def tag(seq: DataFrame, model: Crf) -> DataFrame:
    """(sent_id, pos, token, label, confidence) from (sent_id, pos, token): the best path, in Arrow batches of sentences."""
    shared = seq.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("array<struct<label:string,confidence:double>>")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        crf = pickle.loads(shared.value)
        for texts in batches:
            yield texts.map(lambda t: [{"label": y, "confidence": round(p, 6)} for y, p in zip(*crf.tag(list(t)), strict=True)])

    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    rows = seq.groupBy("sent_id").agg(ordered.alias("x")).withColumn("y", best(F.col("x.token")))
    return rows.select("sent_id", F.explode(F.arrays_zip("x", "y")).alias("z")).select("sent_id", "z.x.pos", "z.x.token", "z.y.label", "z.y.confidence")


def bio_encode(text: Column, slots: Column) -> Column:
    """BIO labels of a text's characters from a map of slot values: slots by name, every occurrence that is still free."""

    def labels(t: str | None, found: dict[str, str]) -> list[str]:
        out = ["O"] * len(t or "")
        for name in sorted(found):
            value, at = found[name] or "", 0
            while value and (at := (t or "").find(value, at)) >= 0:
                if all(x == "O" for x in out[at : at + len(value)]):
                    out[at : at + len(value)] = [f"B-{name}"] + [f"I-{name}"] * (len(value) - 1)
                at += 1
        return out

    @F.pandas_udf("array<string>")
    def encode(texts: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([labels(t, dict(v) if v is not None else {}) for t, v in zip(texts, values, strict=True)])

    return encode(text, slots)
