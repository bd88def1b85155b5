"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards by a hash of their id, so copies of one vector spread evenly, and a shard holds at most
about ``shard_rows``. Each shard keeps its distinct vectors once and links them in a layered graph: upper layers hold a
geometric share of the vectors, a search descends greedily and keeps a beam on the bottom layer. The graph is stored
as flat arrays (neighbour numbers of a fixed width for each layer, ids, vectors) in one row of a written index table.
For largest inner products, vectors are lengthened by one component to equal norms while the graph is built; found
candidates are scored by the inner product of the original vectors in double precision.

Queries are sent in blocks of bounded rows and bytes to all shards, each block's results written before the next is gathered; every
shard returns its best k for each, and the shard results are merged by score, then smaller id. Only the smallest k + 1 ids of equal vectors can be among the best k and not
be the query itself, so no result is lost by keeping those.

Rows: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part;
vectors of different lengths do not meet; rows of a repeated id are candidates each, and queries once for each
distinct vector row; an id's rows are never among its own results; ties go to the smaller id; an empty table, or one without
queries, gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch

#: Rows and bytes of vectors of a shard at most (about), and the number of shards at least.
SHARD_ROWS, SHARD_BYTES, MIN_SHARDS = 10_000, 64 << 20, 8
#: Neighbours on the bottom layer and above, the beam while building, the beam while searching.
WIDTH, UPPER_WIDTH, BUILD_BEAM, SEARCH_BEAM = 24, 12, 48, 256
#: Queries and bytes of their vectors that are sent at a time.
BLOCK_ROWS, BLOCK_BYTES = 50_000, 64 << 20
_STEP = 256


def _search(vec: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, live: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries in step on one layer: (numbers, similarities), best first; -1 where none.

    Each step expands every query's best open candidate; a query ends when its beam has no open one.
    """
    n, width = len(q), graph.shape[1]
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    e = entry.shape[1]
    ids[:, :e] = entry
    sims[:, :e] = np.where(entry >= 0, np.einsum("qed,qd->qe", vec[entry], q), -np.inf)
    done[:, :e] = entry < 0
    visited = np.zeros((n, live), bool)
    rows = np.arange(n)
    visited[rows[:, None], np.maximum(entry, 0)] = True
    while True:
        open_ = np.where(done, -np.inf, sims)
        best = open_.argmax(axis=1)
        act = np.flatnonzero(open_[rows, best] > -np.inf)
        if not len(act):
            break
        b = best[act]
        done[act, b] = True
        near = graph[ids[act, b]]
        fresh = (near >= 0) & ~visited[act[:, None], near]
        visited[act[:, None], np.where(near >= 0, near, ids[act, b][:, None])] = True
        s = np.where(fresh, np.einsum("qwd,qd->qw", vec[near], q[act]), -np.inf).astype(np.float32)
        all_s = np.concatenate([sims[act], s], axis=1)
        keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        pick = np.arange(len(act))[:, None]
        sims[act] = all_s[pick, keep]
        ids[act] = np.concatenate([ids[act], near], axis=1)[pick, keep]
        done[act] = np.concatenate([done[act], ~fresh], axis=1)[pick, keep]
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = sims[rows[:, None], order]
    return np.where(np.isfinite(sims), ids[rows[:, None], order], -1), sims


def _diverse(vec: np.ndarray, q: np.ndarray, cand: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of candidates in falling order, those nearer to the point than to any chosen before; then the nearest others."""
    n, c = cand.shape
    between = np.einsum("nad,nbd->nab", vec[cand], vec[cand])
    chosen = np.zeros((n, c), bool)
    worst = np.full((n, c), -np.inf, np.float32)
    for j in range(c):
        take = (cand[:, j] >= 0) & (sims[:, j] > worst[:, j]) & (chosen.sum(axis=1) < width)
        chosen[:, j] = take
        worst = np.where(take[:, None], np.maximum(worst, between[:, j]), worst)
    rank = np.where(chosen, 0, np.where(cand >= 0, 1, 2)) * c + np.arange(c)
    out = np.take_along_axis(np.where(cand >= 0, cand, -1), np.argsort(rank, axis=1), axis=1)[:, :width]
    return out if c >= width else np.pad(out, ((0, 0), (0, width - c)), constant_values=-1)


def _link(vec: np.ndarray, graph: np.ndarray, new: np.ndarray, near: np.ndarray) -> None:
    """Set the new points' neighbours and add the reverse links, choosing anew where a list overflows."""
    width = graph.shape[1]
    graph[new] = near
    src, dst = np.repeat(new, width), near.ravel()
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    to, first, n = np.unique(dst, return_index=True, return_counts=True)
    most = int(n.max()) if len(n) else 0
    for i in range(0, len(to), _STEP):
        t, f, m = to[i : i + _STEP], first[i : i + _STEP], n[i : i + _STEP]
        offer = f[:, None] + np.arange(most)
        extra = np.where(np.arange(most) < m[:, None], src[np.minimum(offer, len(src) - 1)], -1)
        cand = np.sort(np.concatenate([graph[t], extra], axis=1), axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        sims = np.where(cand >= 0, np.einsum("ncd,nd->nc", vec[cand], vec[t]), -np.inf).astype(np.float32)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
        cand, sims = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1)
        graph[t] = _diverse(vec, vec[t], np.where(np.isfinite(sims), cand, -1), sims, width)


def build(x: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """Neighbour arrays of the layers, bottom first, over vectors in a shuffled order: layer l holds the first size(l)."""
    n = len(x)
    norm = np.linalg.norm(x, axis=1)
    pad = np.sqrt(np.maximum(norm.max() ** 2 - norm**2, 0))
    vec = np.concatenate([x, pad[:, None]], axis=1).astype(np.float32)
    sizes = [n]
    while sizes[-1] > 64:
        sizes.append(max(1, sizes[-1] // 16))
    layers: list[np.ndarray] = [np.full((s, WIDTH if i == 0 else UPPER_WIDTH), -1, np.int64) for i, s in enumerate(sizes)]
    for level in range(len(sizes) - 1, -1, -1):
        graph, size = layers[level], sizes[level]
        at = min(size, 1)
        while at < size:
            new = np.arange(at, min(size, at + min(_STEP, max(1, at))))
            q = vec[new]
            entry = _descend(vec, layers, q, level, at)
            ids, sims = _search(vec, graph, q, entry, min(BUILD_BEAM, max(2, at)), at)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            m = min(len(new) - 1, 16)
            if m:
                also = np.argpartition(-own, m - 1, axis=1)[:, :m]
                ids = np.concatenate([ids, new[also]], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(own, also, axis=1)], axis=1)
                order = np.argsort(-sims, axis=1, kind="stable")
                ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            _link(vec, graph, new, _diverse(vec, q, ids, sims, graph.shape[1]))
            at = int(new[-1]) + 1
    return layers


def _descend(vec: np.ndarray, layers: list[np.ndarray], q: np.ndarray, level: int, live: int) -> np.ndarray:
    """Entry points on a layer: the nearest point found on the layer above, among those that the layer holds yet."""
    entry = np.zeros((len(q), 1), np.int64)
    for upper in range(len(layers) - 1, level, -1):
        ids, _ = _search(vec, layers[upper], q, entry, 4, len(layers[upper]))
        entry = ids[:, :1]
    return np.where((entry >= 0) & (entry < live), entry, 0)


def search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> np.ndarray:
    """Numbers of about the k largest inner products of each query, -1 where there are fewer."""
    x, q = x.astype(np.float32), q.astype(np.float32)
    out = []
    for i in range(0, len(q), _STEP):
        part = q[i : i + _STEP]
        entry = _descend(x, layers, part, 0, len(x))
        ids, _ = _search(x, layers[0], part, entry, min(max(beam, k), max(2, len(x))), len(x))
        out.append(ids[:, :k] if ids.shape[1] >= k else np.pad(ids, ((0, 0), (0, k - ids.shape[1])), constant_values=-1))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


_INDEX = "shard int, dim int, rows int, distinct int, vectors binary, ids binary, id_at binary, layers array<binary>"


def _valid(df: DataFrame) -> DataFrame:
    v = F.col("embedding")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    d = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return d.where(F.col("vec_id").isNotNull() & v.isNotNull() & good)


def _build_rows(keep: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, dim = (k.as_py() for k in key)
        flat = table.column("embedding").combine_chunks().flatten().to_numpy()
        x, ids = flat.reshape(-1, dim), table.column("vec_id").to_numpy()
        x = x + 0.0
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        _, first, group = np.unique(np.ascontiguousarray(x).view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        shuffle = np.random.default_rng(11).permutation(len(first))
        rank = np.empty_like(shuffle)
        rank[shuffle] = np.arange(len(shuffle))
        distinct, member = x[first[shuffle]], rank[group]
        order = np.argsort(member, kind="stable")
        nth = np.arange(len(order)) - np.searchsorted(member[order], member[order])
        order = order[nth < keep]
        at = np.searchsorted(member[order], np.arange(len(first) + 1))
        layers = [g.astype(np.int32).tobytes() for g in build(distinct)]
        row = {"shard": [shard], "dim": [dim], "rows": [len(x)], "distinct": [len(first)], "vectors": [distinct.tobytes()], "ids": [ids[order].tobytes()], "id_at": [at.astype(np.int64).tobytes()], "layers": [layers]}
        types = [pa.int32()] * 4 + [pa.binary()] * 3 + [pa.list_(pa.binary())]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(row.items(), types, strict=True)})

    return run


def _extent(good: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their components in double precision."""
    return tuple(good.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * F.size("embedding").cast("long")), F.lit(0))).first())


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """The index table: one row for each shard and vector length."""
    scratch = scratch or Scratch(vectors.sparkSession, "ann")
    good = _valid(vectors)
    rows, size = _extent(good)
    shards = max(MIN_SHARDS, math.ceil(rows / shard_rows), math.ceil(size / SHARD_BYTES))
    dealt = good.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("dim", F.size("embedding"))
    return scratch.cut(dealt.groupBy("shard", "dim").applyInArrow(_build_rows(k + 1), _INDEX))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    index = build_index(vectors, k, shard_rows, scratch)
    asked = scratch.cut(_valid(queries).distinct())
    rows, size = _extent(asked)
    blocks, found = max(1, math.ceil(rows / block_rows), math.ceil(size / BLOCK_BYTES)), []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64(F.lit(1), F.col("vec_id")), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        dims = np.diff(np.asarray(block.column("embedding").combine_chunks().offsets)) if block.num_rows else np.zeros(0, int)
        qid = block.column("vec_id").to_numpy()
        flat = block.column("embedding").combine_chunks().flatten().to_numpy() if block.num_rows else np.zeros(0)
        starts = np.cumsum(dims) - dims
        by_dim = {int(d): (qid[dims == d], flat[starts[dims == d][:, None] + np.arange(d)]) for d in np.unique(dims)}
        sent = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(len(batch)):
                    yield from _ask({n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}, sent.value, k, beam)

        found.append(scratch.cut(index.mapInArrow(run, "query_id long, vec_id long, score double")))
        sent.destroy()
    found = reduce(DataFrame.unionAll, found)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _ask(row: dict, by_dim: dict, k: int, beam: int) -> Iterator[pa.RecordBatch]:
    dim = row["dim"].as_py()
    if dim not in by_dim:
        return
    qid, q = by_dim[dim]
    x = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, dim)
    ids, at = (np.frombuffer(row[n].as_buffer(), np.int64) for n in ("ids", "id_at"))
    layers = [np.frombuffer(g.as_buffer(), np.int32).astype(np.int64) for g in row["layers"]]
    layers = [g.reshape(-1, WIDTH if i == 0 else UPPER_WIDTH) for i, g in enumerate(layers)]
    for i in range(0, len(q), 4096):
        part, own = q[i : i + 4096], qid[i : i + 4096]
        near = search(x, layers, part, k + 1, beam)
        r, c = np.nonzero(near >= 0)
        node = near[r, c]
        score = np.zeros(len(node))
        for d in range(dim):
            score += x[node, d] * part[r, d]
        n = at[node + 1] - at[node]
        pos = np.repeat(at[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        r, score, vid = np.repeat(r, n), np.repeat(score, n), ids[pos]
        ok = vid != own[r]
        r, score, vid = r[ok], score[ok], vid[ok]
        order = np.lexsort((vid, -score, r))
        r, score, vid = r[order], score[order], vid[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield pa.record_batch([pa.array(own[r[best]]), pa.array(vid[best]), pa.array(score[best])], names=["query_id", "vec_id", "score"])
