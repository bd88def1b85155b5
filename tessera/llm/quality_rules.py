"""Quality rules whose cutoffs are certified on labelled holdouts.

Each rule is a score of a text; a text whose score is above the rule's cutoff is rejected. A rule tries a fixed list of cutoffs
from lenient to strict. In each stratum, for each cutoff, the good documents of the holdout that it would reject are counted: if
the true share of such false rejections were above ``alpha`` over the number of rules, so few would be seen with the probability
of the lower binomial tail only. A cutoff is certified while that tail stays at most ``delta`` over the number of chains (strata
times rules), and a chain ends at its first cutoff that isn't: testing in a fixed order needs no further correction within a
chain, Bonferroni's corrects between chains. So, with probability 1 - ``delta``, in every stratum at once all rules together
reject at most ``alpha`` of the good documents that pass the base rules; as far as labelled documents are drawn like the others.

Among certified cutoffs the one with the greatest gain on the learning part counts: rejected bad less rejected good documents,
ties to the more lenient; without a gain the rule is off. The learning part (crc32 of doc_id mod ``PARTS`` is 0) and the holdout
share no document. A stratum with too few labels to certify anything keeps all that passes the base rules.

Rows: null and empty texts have no words, so they fail the base rules; texts are read whole; repeated rows are judged alike and
each counts as a label's document; several labels of a doc_id count as one, good if any is; labels that are null or neither 0 nor 1
and null doc_ids teach nothing; a null stratum is one of its own; empty tables give empty ones. Without labels all rules are off.
Words, lines and windows are compared by 64-bit hashes: two unlike ones of a text of n are taken for equal with a chance below
n * n / 2**64. Other columns stay; columns named like the statistics, ``base_failed`` or ``kept`` are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import buffers, chunks, mix, multipliers, run_hashes, runs, shingles
from .store import Scratch, crc_mod, free_name, lean_workers, replace_columns, sized

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
#: Parts of the labelled documents, by crc32 of doc_id; part 0 learns, the others are the holdout.
PARTS = 4
ALPHA, DELTA = 0.03, 0.1
WINDOW = 3
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Rule:
    """A score, as an SQL expression over the statistics, and its cutoffs from lenient to strict."""

    name: str
    score: str
    cutoffs: tuple[float, ...]


def falling(first: float, last: float, steps: int = 20) -> tuple[float, ...]:
    return tuple(round(first + (last - first) * i / (steps - 1), 6) for i in range(steps))


RULES = (
    Rule("symbols", "n_symbols / nullif(n_words, 0)", falling(1.0, 0.05)),
    Rule("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", falling(1.0, 0.05)),
    Rule("repeats", "n_repeat_words / nullif(n_words, 0)", falling(0.5, 0.025)),
    Rule("capitals", "n_capitals / nullif(word_chars, 0)", falling(1.0, 0.05)),
    Rule("marks", "n_marks / nullif(n_words, 0)", falling(1.0, 0.05)),
    Rule("long_words", "word_chars / nullif(n_words, 0)", falling(15.0, 5.5)),
)


# -- statistics --------------------------------------------------------------------------------------------------------


def _table(of: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(of.encode())] = True
    return t


_SPACE, _SYMBOL, _CAPITAL, _MARK = _table(" \t\n\v\f\r"), _table(SYMBOLS), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("!?")


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _in_row(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashes, mixed with their row, so that equal ones of different rows differ."""
    row = np.repeat(np.arange(1, len(at), dtype=np.uint64), np.diff(at))
    return mix(h ^ mix(row * multipliers(1, seed=11)[0]))


def _measure(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The statistics of each row of a chunk of texts."""
    inside = ~_SPACE[data]
    first, last = runs(inside, bounds)
    at = np.searchsorted(first, bounds)
    words = np.diff(at)
    code_points = _per_row(inside & ((data & 0xC0) != 0x80), bounds)
    # lines: runs between line feeds that hold a word
    lo, hi = runs(data != 10, bounds)
    filled = np.searchsorted(first, hi, side="right") > np.searchsorted(first, lo)
    lo, hi = lo[filled], hi[filled]
    line_at = np.searchsorted(lo, bounds)
    key = _in_row(run_hashes(data.astype(np.uint16) + 1, lo, hi), line_at)
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    # windows that occur twice in a row cover all their words
    h = run_hashes(data.astype(np.uint16) + 1, first, last)
    grams, gram_at = shingles(h, at, WINDOW)
    whole = np.repeat(words >= WINDOW, np.diff(gram_at))
    _, which, n = np.unique(_in_row(grams, gram_at), return_inverse=True, return_counts=True)
    twice = np.flatnonzero((n[which] > 1) & whole)
    row = np.searchsorted(gram_at, twice, side="right") - 1
    covered = np.zeros(len(first), bool)
    for j in range(WINDOW):
        covered[at[row] + (twice - gram_at[row]) + j] = True
    return [
        words, code_points, _per_row(_SYMBOL[data], bounds), _per_row(again, line_at), _per_row(covered, at), np.diff(line_at),
        _per_row(_CAPITAL[data], bounds), _per_row(_MARK[data], bounds),
    ]


def measure_texts(texts: pa.Array) -> pa.StructArray:
    data, bounds = buffers(texts)
    parts = [_measure(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in chunks(bounds)]
    cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(STATS))]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in cols], list(STATS))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the statistics of their whole texts and ``base_failed``."""
    lean_workers(docs.sparkSession)

    @F.arrow_udf(", ".join(f"{c} long" for c in STATS))
    def stats(t: pa.Array) -> pa.Array:
        return measure_texts(t)

    name = free_name(docs, "quality_stats")
    with_stats = docs.withColumn(name, stats(F.col(text).cast("string")))
    out = replace_columns(with_stats, {c: F.col(f"{name}.{c}") for c in STATS})
    return replace_columns(out.drop(name), {"base_failed": F.expr(BASE_FAILED)})


# -- thresholds --------------------------------------------------------------------------------------------------------


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws with probability p, summed from the largest term down; 1 where k is at least the mean."""
    if n <= 0 or k >= p * n:
        return 1.0
    logs = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, top, i = 1.0, 1.0, k
    while i > 0 and top > 1e-18 * total:
        j = np.arange(i, max(0, i - 4096), -1, dtype=np.float64)
        terms = top * np.cumprod(j * (1 - p) / ((n - j + 1) * p))
        total, top, i = total + float(terms.sum()), float(terms[-1]), i - len(j)
    return min(1.0, math.exp(logs + math.log(total)))


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str = "lang", label: str = "quality", rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n, false_rejections, tail) of the rules that are on, by the measured documents and their labels.

    Rows are the good ones of the holdout; they are summed to one row for each stratum, rule and first rejecting cutoff before anything is shuffled.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    y = y.groupBy("doc_id").agg(F.max("y").alias("y"))
    scored = measured.where("not base_failed").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).alias("stratum"), *STATS)
    both = scored.join(y, "doc_id").withColumn("learns", crc_mod(F.col("doc_id"), PARTS) == 0)
    # a text is rejected by the cutoffs from the first that it exceeds on, as they fall
    passed = [reduce(add, [(~F.coalesce(F.expr(r.score) > c, F.lit(False))).cast("int") for c in r.cutoffs]) for r in rules]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), x.alias("place")) for i, x in enumerate(passed)]))
    rows = both.select("stratum", "y", "learns", each.alias("x")).select("stratum", "y", "learns", "x.*")
    good = F.col("y") == 1
    counted = rows.groupBy("stratum", "rule", "place").agg(
        F.sum((good & ~F.col("learns")).cast("long")).alias("n"), F.sum(F.when(F.col("learns"), F.when(good, -1).otherwise(1)).otherwise(0)).cast("long").alias("gain")
    )
    scratch = Scratch(measured.sparkSession, "rules")
    chain = scratch.cut(counted.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("place", "n", "gain")).alias("at")).where("n > 0"))

    def upto(i: Column, name: str) -> Column:
        return F.aggregate(F.filter("at", lambda x: x["place"] <= i), F.lit(0).cast("long"), lambda s, x: s + x[name])

    most = max(len(r.cutoffs) for r in rules)
    tried = chain.select("stratum", "rule", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.struct(i.alias("i"), upto(i, "n").alias("k"), upto(i, "gain").alias("gain")))).alias("x"))
    cutoff = F.get(F.get(F.array(*[F.array(*map(F.lit, r.cutoffs)) for r in rules]), F.col("rule")), F.col("i"))
    tried = tried.select("stratum", "rule", "n", "x.*").withColumn("cutoff", cutoff).where("cutoff is not null")

    @F.arrow_udf("double")
    def tail(k: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([binomial_tail(a, b, alpha / len(rules)) for a, b in zip(k.to_pylist(), n.to_pylist(), strict=True)], pa.float64())

    tried = tried.withColumn("tail", tail("k", "n"))
    chains = max(1, chain.count())
    failed = F.min(F.when(F.col("tail") > delta / chains, F.col("i"))).over(W.partitionBy("stratum", "rule"))
    certified = tried.withColumn("failed", failed).where("gain > 0 and (failed is null or i < failed)")
    best = certified.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n", "k", "tail"), F.struct(F.col("gain"), -F.col("i"))).alias("b"))
    name = F.get(F.array(*[F.lit(r.name) for r in rules]), F.col("rule"))
    return scratch.cut(best.select("stratum", name.alias("rule"), "b.cutoff", "b.n", F.col("b.k").alias("false_rejections"), "b.tail"))


def judge(measured: DataFrame, found: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measured documents with ``kept``: neither failed by the base rules nor above a cutoff of their stratum."""
    names = [free_name(measured, f"cutoff_{r.name}") for r in rules]
    key = free_name(measured, "stratum")
    wide = found.groupBy(F.col("stratum").alias(key)).agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(c) for r, c in zip(rules, names, strict=True)])
    both = measured.join(sized(wide, wide.count()), F.col(f"`{stratum}`").eqNullSafe(F.col(key)), "left")
    above = F.lit(False)
    for r, c in zip(rules, names, strict=True):
        above = above | F.coalesce(F.expr(r.score) > F.col(c), F.lit(False))
    return replace_columns(both, {"kept": ~F.col("base_failed") & ~above}).drop(key, *names)
