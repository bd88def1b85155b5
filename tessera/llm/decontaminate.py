"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits (ASCII letters lower-cased, other characters as they are). Fixed masks pick
token positions and ignore the others; the hashes of the picked tokens at every position of every benchmark passage
form the test side of a hash join, and every position of every document is looked up in it. Around each hit the
document and the passage are compared position by position on the hit's diagonal, so substituted words cost only
themselves. A document is contaminated by a passage when any stretch of the diagonal holds at least ``min_words``
equal words, or the whole passage where it is shorter, at an identity of at least ``identity``. At an identity of 0.8
or more and 13 words or more such a stretch has four equal words in a row (k different words leave k + 1 runs for at
least max(13, 4 k) equal ones), so the mask of four words finds every one; the others add to it below that.

The test side is joined in blocks of at most ``block_words`` benchmark words. One block at a time is on the
executors and two on the driver, so a benchmark of any size takes more passes, not more memory; documents are shuffled only to leave contaminated
ones out where those are too many to be sent.

Rows: null or empty texts are clean; texts of any length are read whole, in memory by their own length; an empty table gives none; a passage without words matches nothing; passages with the same words count as
their smallest item_id (rows without an item_id take no part); repeated documents are each judged; other columns
are kept by ``remove_contaminated`` and ignored by ``contamination``. A passage shorter than a mask is looked up by
all of its words together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import buffers, chunks, letter_table, mix, multipliers, words
from .store import Scratch, free_name, sized

#: Fixed masks: 1 takes a token position, 0 ignores it.
MASKS = ("1111", "111111", "110100111", "10110010101", "1100101000011")
MIN_WORDS = 13
IDENTITY = 0.8
BLOCK_WORDS = 1_000_000
#: Hits that are held at a time.
HITS = 1 << 20

_RESULT = "doc_id long, item_id long, doc_word long, item_word long, matched long, span long, identity double"


@dataclass
class Block:
    """Passages of a block: words one after another, and for each mask the sorted hashes with their word positions."""

    items: np.ndarray
    at: np.ndarray
    tokens: np.ndarray
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def seed_hashes(h: np.ndarray, at: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the picked tokens at every position whose whole span lies in one row, and those positions."""
    span = int(offsets[-1]) + 1
    if len(h) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m, n = multipliers(len(offsets), 100 + salt), len(h) - span + 1
    acc = np.zeros(n, np.uint64)
    for j, o in enumerate(offsets):
        acc += h[o : o + n] * m[j]
    fits = np.ones(n, bool)
    for e in at[1:-1]:
        fits[max(0, e - span + 1) : max(0, min(e, n))] = False
    pos = np.flatnonzero(fits)
    return mix(acc[pos]), pos


def _masks(lengths: set[int]) -> list[np.ndarray]:
    """The fixed masks, and one of all words for every passage length that some mask does not fit."""
    fixed = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]
    least = min(len(m) for m in MASKS)
    return fixed + [np.arange(n) for n in sorted(lengths) if 0 < n < least]


def build_block(items: list[int], texts: list[str]) -> Block:
    data, bounds = buffers(pa.array(texts, pa.string()))
    h, at = words(data, bounds, letter_table())
    seeds = []
    for i, o in enumerate(_masks(set(np.diff(at).tolist()))):
        value, pos = seed_hashes(h, at, o, i)
        order = np.argsort(value, kind="stable")
        bits = np.zeros(1 << 20, bool)
        bits[(value >> np.uint64(44)).astype(np.int64)] = True
        seeds.append((o, value[order], pos[order], bits))
    return Block(np.array(items, np.int64), at, h, seeds)


def _best(same: np.ndarray, least: int, identity: float) -> tuple[int, int, int] | None:
    """(equal words, start, end) of the stretch with most equal words of all that hold the identity, if it has ``least``."""
    equal = np.concatenate([[0], np.cumsum(same)])
    over = equal - identity * np.arange(len(equal))
    # for each start the last end at which the identity holds: the most that can still come falls with the end
    most = np.maximum.accumulate(over[::-1])
    end = len(over) - 1 - np.searchsorted(most, over - 1e-9)
    matched = equal[end] - equal
    start = int(np.argmax(matched))
    if matched[start] < max(1, least):
        return None
    hit = start + np.flatnonzero(same[start : end[start]])
    return int(matched[start]), int(hit[0]), int(hit[-1]) + 1


def _enough(block: Block, h: np.ndarray, at: np.ndarray, hits: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the diagonals (row, item, shift) those with equal words enough in all, and how many; compared in pieces of bounded size."""
    row, item, shift = hits.T
    have, size = np.diff(at)[row], np.diff(block.at)[item]
    a = np.maximum(0, -shift)
    n = np.minimum(size, have - shift) - a
    equal, done = np.zeros(len(hits), np.int64), np.cumsum(n)
    i = 0
    while i < len(hits):
        j = max(i + 1, int(np.searchsorted(done, done[i] - n[i] + (1 << 20), side="right")))
        first = np.cumsum(n[i:j]) - n[i:j]
        step = np.arange(n[i:j].sum()) - np.repeat(first, n[i:j])
        same = h[np.repeat((at[row] + a + shift)[i:j], n[i:j]) + step] == block.tokens[np.repeat((block.at[item] + a)[i:j], n[i:j]) + step]
        equal[i:j] = np.add.reduceat(same, first, dtype=np.int64)
        i = j
    keep = equal >= np.minimum(min_words, size)
    return hits[keep], equal[keep]


def _diagonals(block: Block, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The distinct (row, item, shift) on which a seed is shared; hits are gathered in pieces, so that words that
    repeat on both sides cost their diagonals and not their hits."""
    items, most = len(block.items), int(np.diff(block.at).max(initial=0))
    width = len(h) + most + 1
    found = np.zeros(0, np.int64)  # (row, item, shift + most) as one number: rows and shifts are bounded by the words of a chunk
    for i, (o, value, pos, bits) in enumerate(block.seeds):
        s, where = seed_hashes(h, at, o, i)
        maybe = np.flatnonzero(bits[(s >> np.uint64(44)).astype(np.int64)]) if len(value) else np.zeros(0, np.int64)
        left, right = (np.searchsorted(value, s[maybe], side=x) for x in ("left", "right"))
        some = right > left
        maybe, left, n = maybe[some], left[some], (right - left)[some]
        done, a = np.cumsum(n), 0
        while a < len(maybe):
            b = max(a + 1, int(np.searchsorted(done, done[a] - n[a] + HITS, side="right")))
            m = n[a:b]
            hit = np.repeat(where[maybe[a:b]], m)
            test = pos[np.repeat(left[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            row, item = np.searchsorted(at, hit, side="right") - 1, np.searchsorted(block.at, test, side="right") - 1
            shift = (hit - at[row]) - (test - block.at[item])
            found = np.unique(np.concatenate([found, (row * items + item) * width + shift + most]))
            a = b
    return np.stack([found // width // items, found // width % items, found % width - most], axis=1)


def overlaps(block: Block, h: np.ndarray, at: np.ndarray, min_words: int, identity: float) -> list[tuple]:
    """(row, item, doc word, item word, matched, span) of the stretch with most equal words for every row and passage that overlap."""
    best: dict[tuple[int, int], tuple] = {}
    hits, equal = _enough(block, h, at, _diagonals(block, h, at), min_words)
    # those with most equal words first: no stretch has more than its diagonal
    order = np.argsort(-equal, kind="stable")
    for (row, item, shift), most in zip(hits[order].tolist(), equal[order].tolist(), strict=True):
        if most <= best.get((row, item), (0,))[0]:
            continue
        doc, test = h[at[row] : at[row + 1]], block.tokens[block.at[item] : block.at[item + 1]]
        a, b = max(0, -shift), min(len(test), len(doc) - shift)
        found_here = _best(doc[a + shift : b + shift] == test[a:b], min(min_words, len(test)), identity)
        if found_here and found_here[0] > best.get((row, item), (0,))[0]:
            matched, s, e = found_here
            best[row, item] = (matched, a + s + shift, a + s, e - s)
    return [(int(r), int(block.items[i]), int(d), int(t), m, int(n)) for (r, i), (m, d, t, n) in sorted(best.items())]


def _rows(batch_text, block: Block, min_words: int, identity: float) -> Iterator[tuple]:
    data, bounds = buffers(batch_text)
    for i, j in chunks(bounds, 1 << 19):
        h, at = words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], letter_table())
        for r, *rest in overlaps(block, h, at, min_words, identity):
            yield i + r, *rest


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[Block]:
    """The benchmark's passages, each set of equal words once, in blocks of a bounded number of words."""
    norm = F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), norm.alias("text")).where("item_id is not null and text <> ''")
    items = items.groupBy("text").agg(F.min("item_id").alias("item_id")).orderBy("item_id")
    ids, texts, n = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        n += row.text.count(" ") + 1
        if n >= block_words:
            yield build_block(ids, texts)
            ids, texts, n = [], [], 0
    if ids:
        yield build_block(ids, texts)


def _by_block(docs: DataFrame, benchmark: DataFrame, block_words: int, run_with, schema: str) -> DataFrame | None:
    """The results of all blocks, or None without any. One block is a lazy plan; of several, each is written and forgotten, so that two at most are on the driver."""
    spark, scratch = docs.sparkSession, None
    blocks, out = _blocks(benchmark, block_words), None
    block, after = next(blocks, None), None
    while block is not None:
        sent, after = spark.sparkContext.broadcast(block), next(blocks, None)
        part = docs.mapInArrow(run_with(sent), schema)
        if after is not None or out is not None:
            scratch = scratch or Scratch(spark, "decontaminate")
            part = scratch.cut(part)
            sent.destroy()
        out, block = part if out is None else out.unionAll(part), after
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and passage that overlap, with the best stretch: word positions, equal words, span."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run_with(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_rows(batch.column(1), sent.value, min_words, identity))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                cols = [pa.array([r[c] for r in rows], pa.int64()) for c in range(1, 6)]
                share = pa.array([r[4] / r[5] for r in rows], pa.float64())
                yield pa.record_batch([ids, *cols, share], names=["doc_id", "item_id", "doc_word", "item_word", "matched", "span", "identity"])

        return run

    out = _by_block(keyed, benchmark, block_words, run_with, _RESULT)
    return docs.sparkSession.createDataFrame([], _RESULT) if out is None else out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that no passage contaminates, with all their columns.

    A benchmark of one block takes one pass without a shuffle. Of several blocks, each finds the contaminated texts' hashes (two of 64
    bits), and the documents are read once more to leave those out.
    """
    if "text" not in docs.columns:
        raise ValueError("documents need a column text")
    blocks = _blocks(benchmark, block_words)
    block = next(blocks, None)
    if block is None:
        return docs
    if next(blocks, None) is None:
        sent, at = docs.sparkSession.sparkContext.broadcast(block), docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(len(batch), bool)
                stays[[r for r, *_ in _rows(batch.column(at), sent.value, min_words, identity)]] = False
                yield batch.filter(pa.array(stays))

        return docs.mapInArrow(keep, docs.schema)
    keys = [F.xxhash64(F.lit(seed), F.col("text").cast("string")) for seed in (1, 2)]
    names = [free_name(docs, x) for x in ("_key", "_check")]
    keyed = docs.select(F.col("text").cast("string").alias("text"), *[k.alias(n) for k, n in zip(keys, names, strict=True)])

    def run_with(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = pa.array(sorted({r for r, *_ in _rows(batch.column(0), sent.value, min_words, identity)}), pa.int64())
                yield batch.select(names).take(rows)

        return run

    bad = _by_block(keyed, benchmark, block_words, run_with, ", ".join(f"`{n}` long" for n in names))
    bad = Scratch(docs.sparkSession, "decontaminate").cut(bad.distinct())
    marked = docs.withColumns(dict(zip(names, keys, strict=True)))
    return marked.join(sized(bad, bad.count()), names, "left_anti").select(docs.columns)
