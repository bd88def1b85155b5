"""A stored inverted file of vectors: cells of a k-means, searched by the cells nearest to a query, with filters on other columns.

The centroids are trained on a bounded sample of unit vectors (``SAMPLE_BYTES``); every vector is kept, in the folder of its nearest centroid. A
search reads the folders of its queries' cells only, and a filter reaches the scan of these folders. The share of the exact neighbours that
it finds depends on the number of cells it probes; ``recall`` measures it.

Rows: vectors that are null, empty, zero or hold null or non-finite components are left out; repeated rows are all kept; vectors of
another size than the most frequent of the sample are left out. Extra columns are kept for filters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .lexical import top_k
from .ranking import _HITS, _matrices, nearest_of, query_blocks, whole_vectors

#: Bytes of the vectors that train the centroids, and the most cells, which bound what a search sends to its tasks.
SAMPLE_BYTES, MOST_CELLS = 32 << 20, 4096
#: Pairs of a query and a cell that a block of queries has.
MOST_PROBES = 4 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train_cells(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors by k-means on the sphere; a cell that loses all vectors starts again at a random one."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        best = np.concatenate([np.argmax(x[i : i + 65536] @ c.T, axis=1) for i in range(0, len(x), 65536)])
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        empty = np.bincount(best, minlength=len(c)) == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = _unit(total)
    return c


def _nearest_cells(q: np.ndarray, c: np.ndarray, few: int) -> np.ndarray:
    """The ``few`` nearest cells of each query; the driver holds the products of some queries at a time."""
    out = np.zeros((len(q), few), np.int32)
    for i in range(0, len(q), 1024):
        out[i : i + 1024] = np.argsort(-(q[i : i + 1024] @ c.T), axis=1, kind="stable")[:, :few]
    return out


class VectorIndex:
    """The vectors and centroids below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        table = spark.read.parquet(f"{self.path}/centroids").orderBy("cell").toArrow()
        self.centroids = next(_matrices(table, "centroid"))[1]

    @classmethod
    def create(cls, vectors: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Train on a sample by hash and write vectors (doc_id, embedding, ...) by cell; about a root of their number of cells."""
        spark = vectors.sparkSession
        usable = vectors.where(whole_vectors("embedding")).where(F.forall("embedding", lambda x: F.abs(x) < float("inf")) & F.exists("embedding", lambda x: x != 0))
        sizes = usable.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        d, n = (sizes[0].d, sizes[0].n) if sizes else (1, 0)
        usable = usable.where(F.size("embedding") == d)
        most = max(1, SAMPLE_BYTES // (8 * d))
        share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(min(1.0, most / max(n, 1)) * (1 << 20)) + 1
        sample = usable.where(share).select("embedding").limit(most).toArrow()
        x = _unit(next(_matrices(sample, "embedding"))[1]) if len(sample) else np.eye(1)
        c = train_cells(x, cells or int(min(MOST_CELLS, max(1, round(max(n, 1) ** 0.5)))), seed=seed)
        spark.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        sent = spark.sparkContext.broadcast(c)

        @F.arrow_udf("int")
        def cell(v: pa.Array) -> pa.Array:
            out = np.zeros(len(v), np.int32)
            for rows, y in _matrices(pa.table({"v": v}), "v"):
                for i in range(0, len(rows), 8192):
                    out[rows[i : i + 8192]] = np.argmax(_unit(y[i : i + 8192]) @ sent.value.T, axis=1)
            return pa.array(out)

        usable.withColumn("cell", cell("embedding")).write.partitionBy("cell").parquet(f"{path}/cells")
        return cls(spark, path)

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, where: Column | None = None) -> DataFrame:
        """The k nearest found of each query (query_id, qv) by inner product, among rows that the filter keeps: (query_id, doc_id, score, rank)."""
        c, few = self.centroids, min(probes, len(self.centroids))
        asked = queries.where(whole_vectors("qv") & (F.size("qv") == c.shape[1])).select(F.col("query_id").cast("long").alias("query_id"), "qv")
        parts, blocks = [], list(query_blocks(asked, max(1, MOST_PROBES // max(1, few))))
        for block in blocks:
            table = block.toArrow()
            if not len(table):
                continue
            near = _nearest_cells(next(_matrices(table, "qv"))[1], c, few)
            v = self.vectors().where(F.col("cell").isin(np.unique(near).tolist()))
            v = (v if where is None else v.where(where)).select(F.col("doc_id").cast("long").alias("doc_id"), "embedding", F.col("cell").cast("long").alias("cell"))
            found = top_k(nearest_of(v, table, k, near), k)
            # each of many blocks is done with before the next one is read
            parts.append(found if len(blocks) == 1 else cut(found))
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], _HITS)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact hits (query_id, doc_id) that were found, and their number."""
    both = exact.select("query_id", "doc_id").distinct().join(found.select("query_id", "doc_id").distinct().withColumn("found", F.lit(1)), ["query_id", "doc_id"], "left")
    return both.agg(F.round(F.coalesce(F.sum("found"), F.lit(0)) / F.count(F.lit(1)), 6).alias("recall"), F.count(F.lit(1)).alias("exact_hits"))


