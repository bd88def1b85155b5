"""Dense search, score normalisation, fusion, diversification and fallback over hit lists (query_id, doc_id, score)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .lexical import top_k


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, zero: str = "zero") -> Column:
    """Unit vector; a zero vector stays (zero), or becomes the unit vector of equal components (unit)."""
    n = norm(v)
    flat = F.transform(v, lambda x: F.lit(1.0) / F.sqrt(F.size(v)))
    return F.when(n < 1e-8, flat if zero == "unit" else v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


#: Bytes of query vectors that go to the executors at a time, and products that a task holds at a time.
QUERY_BYTES, PRODUCTS = 32 << 20, 4 << 20


def whole_vectors(c: str) -> Column:
    """Neither null nor empty, and without null components."""
    return F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull())


def _matrices(table: pa.Table | pa.RecordBatch, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) for each size of vectors."""
    col = table.column(vector)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        flat = pc.list_flatten(col.take(pa.array(rows))).to_numpy(zero_copy_only=False)
        yield rows, flat.astype(np.float64).reshape(len(rows), int(d))


class Best:
    """The k best (id, score) of each query that a task has met, by the query's number; ties go to the smaller id.

    ``least`` is what a row must reach to come in, from the last merge; what is added is merged when it has grown. ``more`` values go with a row.
    """

    def __init__(self, queries: int, k: int, more: int = 0) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.most, self.waiting = 2 * queries * k, 0
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0) for _ in range(1 + more)])]

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray, *more: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, ids, score, *more))
            self.waiting += len(query)
            if self.waiting >= self.most:
                self.rows()

    def rows(self) -> tuple[np.ndarray, ...]:
        """(queries' numbers, ids, scores, and what goes with them), by query and from the best on."""
        if len(self.parts) > 1:
            q, ids, score, *more = (np.concatenate(v) for v in zip(*self.parts, strict=True))
            order = np.lexsort((ids, -score, q))
            q, ids, score, *more = (x[order] for x in (q, ids, score, *more))
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == self.k - 1
            self.least[q[last]] = score[last]
            keep = place < self.k
            self.parts, self.waiting = [tuple(x[keep] for x in (q, ids, score, *more))], 0
        return self.parts[0]


def _meet(best: Best, ids: np.ndarray, x: np.ndarray, asked: np.ndarray, qids: np.ndarray, q: np.ndarray) -> None:
    """Take the k best rows of a batch for each of the asked queries (their numbers), its own row left out."""
    step = max(1, PRODUCTS // max(1, len(ids)))
    for i in range(0, len(asked), step):
        some = asked[i : i + step]
        score = np.round(q[some] @ x.T, 6)
        score[qids[some, None] == ids[None, :]] = -np.inf
        least = best.least[some][:, None]
        if score.shape[1] > 4 * best.k:
            # all that reach the k-th score stay, so that ties are settled by id
            least = np.maximum(least, -np.partition(-score, best.k - 1, axis=1)[:, best.k - 1 : best.k])
        r, c = np.nonzero((score >= least) & (score > -np.inf))
        best.add(some[r], ids[c], score[r, c])


def nearest_of(vectors: DataFrame, asked: pa.Table, k: int, cells: np.ndarray | None = None) -> DataFrame:
    """(query_id, doc_id, score): of each task's vectors (doc_id, embedding) the k best of each query of a bounded table (query_id, qv).

    With ``cells``, which has a row of cells for each query, vectors, which have a column ``cell`` then, meet the queries of their cell only: each
    query's vector is sent once however many cells it has. A product of two matrices scores a batch.
    """
    ids, groups = asked.column("query_id").to_numpy(), {}
    for rows, q in _matrices(asked, "qv"):
        here = np.zeros(len(rows), np.int64) if cells is None else cells[rows].ravel()
        number = np.repeat(np.arange(len(rows), dtype=np.int32), len(here) // len(rows))
        by = np.argsort(here, kind="stable")
        names, first = np.unique(here[by], return_index=True)
        groups[q.shape[1]] = (rows, q, dict(zip(names.tolist(), np.split(number[by], first[1:]), strict=True)))
    sent, by_cells = vectors.sparkSession.sparkContext.broadcast((ids, groups)), cells is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups = sent.value
        best = {d: Best(len(g[0]), k) for d, g in groups.items()}
        for batch in batches:
            doc = batch.column("doc_id").to_numpy()
            of = batch.column("cell").to_numpy() if by_cells else np.zeros(len(batch), np.int64)
            for rows, x in _matrices(batch, "embedding"):
                if x.shape[1] not in groups:
                    continue
                numbers, q, by_cell = groups[x.shape[1]]
                for c in np.unique(of[rows]):
                    if int(c) in by_cell:
                        here = of[rows] == c
                        _meet(best[x.shape[1]], doc[rows[here]], x[here], by_cell[int(c)], ids[numbers], q)
        for d, found in best.items():
            q, doc, score = found.rows()
            yield pa.record_batch([pa.array(ids[groups[d][0]][q].astype(np.int64)), pa.array(doc.astype(np.int64)), pa.array(score)], names=["query_id", "doc_id", "score"])

    return vectors.mapInArrow(run, "query_id long, doc_id long, score double")


def query_blocks(queries: DataFrame, most: int | None = None) -> Iterator[DataFrame]:
    """The queries (query_id, qv) in parts of about ``QUERY_BYTES``, and of about ``most`` rows if given, by the hash of their id."""
    n, total = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("qv").cast("long") * 8), F.lit(0))).first()
    blocks = max(1, -(-total // QUERY_BYTES), -(-n // most) if most else 1) if n else 0
    for b in range(blocks):
        yield queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)


_HITS = "query_id long, doc_id long, score double, rank int"


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, block_rows: int | None = None) -> DataFrame:
    """Exact k nearest by inner product. vectors: (doc_id, embedding); queries: (query_id, qv), any number.

    The vectors are read once for each block of queries, which is sent to the executors; a task keeps the k best of each batch, so
    few rows are shuffled. Vectors that are null or hold a null are left out, and a query's own row.
    """
    v = (vectors if where is None else vectors.where(where)).where(whole_vectors("embedding")).select(F.col("doc_id").cast("long").alias("doc_id"), "embedding")
    asked = queries.where(whole_vectors("qv")).select(F.col("query_id").cast("long").alias("query_id"), "qv")
    parts, blocks = [], list(query_blocks(asked, block_rows))
    for block in blocks:
        found = top_k(nearest_of(v, block.toArrow(), k), k)
        # each of many blocks is done with before the next one is read
        parts.append(found if len(blocks) == 1 else cut(found))
    return reduce(DataFrame.unionAll, parts) if parts else vectors.sparkSession.createDataFrame([], _HITS)


def normalise(hits: DataFrame, method: str = "auto") -> DataFrame:
    """hits with ``norm`` in 0..1: clamp, minmax, log_minmax, zscore, or by the range of the query's scores (auto).

    A query whose scores are all equal gets 0.5, and so does a null score.
    """
    q = W.partitionBy("query_id")
    s = F.col("score").cast("double")

    def minmax(x: Column) -> Column:
        lo, hi = F.min(x).over(q), F.max(x).over(q)
        return F.when(x.isNull() | (hi == lo), 0.5).otherwise((x - lo) / (hi - lo))

    clamp = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), F.lit(0.5))
    logs = minmax(F.signum(s) * F.log1p(F.abs(s)))
    sd = F.stddev_pop(s).over(q)
    z = F.when(sd == 0, 0.5).otherwise(1 / (1 + F.exp(-(s - F.avg(s).over(q)) / sd)))
    lo, hi = F.min(s).over(q), F.max(s).over(q)
    auto = F.when((lo >= -1) & (hi <= 1), clamp).when((lo < -100) | (hi > 100), logs).when((lo >= 0) & (hi > 1), minmax(s)).otherwise(logs)
    pick = {"clamp": clamp, "minmax": minmax(s), "log_minmax": logs, "zscore": z, "auto": auto}[method]
    return hits.withColumn("norm", F.round(pick, 6))


def relevance_filter(hits: DataFrame, least: float) -> DataFrame:
    return hits.where(F.coalesce("norm", "score", F.lit(0.0)) >= least)


def deduplicate(hits: DataFrame) -> DataFrame:
    """The best score of each query and document."""
    return hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def weighted(lexical: DataFrame, dense: DataFrame, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """alpha of the dense and 1 - alpha of the lexical score, each min-max scaled; a missing side counts 0."""
    parts = normalise(lexical, "minmax").select("query_id", "doc_id", (F.col("norm") * (1 - alpha)).alias("part"))
    parts = parts.unionAll(normalise(dense, "minmax").select("query_id", "doc_id", (F.col("norm") * alpha).alias("part")))
    return top_k(parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 7).alias("score")), k)


def rrf(lists: list[DataFrame], constant: int = 60, window: int = 100, k: int = 10, list_weights: list[float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: sum of w / (constant + rank) over ranks up to the window."""
    if constant <= 0 or not 0 < window <= 300:
        raise ValueError("the constant must be positive and the window in 1..300")
    ws = list_weights or [1.0] * len(lists)
    parts = [x.where(F.col("rank") <= window).select("query_id", "doc_id", (F.lit(w) / (constant + F.col("rank"))).alias("part")) for x, w in zip(lists, ws, strict=True)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return top_k(every.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")), k)


def best_fields(scores: list[Column], tie: float = 0.3) -> Column:
    """The best field score and a share of the others'."""
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return best + tie * (total - best)


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Replace the scores by those of a pluggable column and keep the k best."""
    return top_k(hits.withColumn("score", score).drop("rank"), k)


def overlap_score(query_tokens: Column, text_tokens: Column) -> Column:
    """The default reranker: Jaccard similarity of token sets."""
    union = F.size(F.array_union(query_tokens, text_tokens))
    return F.when(union > 0, F.round(F.size(F.array_intersect(query_tokens, text_tokens)) / union, 6)).otherwise(0.0)


def mmr(hits: DataFrame, k: int = 10, weight: float = 0.7, candidates: int = 200) -> DataFrame:
    """Greedy maximal marginal relevance of (query_id, doc_id, score, embedding): (query_id, rank, doc_id, mmr).

    Greedy choice is sequential, so a query's candidates, cut to the best ``candidates`` before, are one pandas group.
    """
    best = top_k(hits, candidates).select("query_id", "doc_id", "score", F.col("embedding").cast("array<double>").alias("embedding"))

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("doc_id", kind="stable")
        x, rel = np.array(g["embedding"].tolist()), g["score"].to_numpy()
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.where(length < 1e-8, 1 / np.sqrt(x.shape[1]), x / np.maximum(length, 1e-8))
        near, left, rows = np.zeros(len(g)), np.ones(len(g), bool), []
        for rank in range(1, min(k, len(g)) + 1):
            value = np.round(weight * rel - (1 - weight) * near, 9)
            i = int(np.argmax(np.where(left, value, -np.inf)))
            rows.append((int(g["query_id"].iloc[0]), rank, int(g["doc_id"].iloc[i]), float(round(value[i], 6))))
            left[i] = False
            near = np.maximum(near, x @ x[i]) if rank > 1 else x @ x[i]
        return pd.DataFrame(rows, columns=["query_id", "rank", "doc_id", "mmr"])

    return best.groupBy("query_id").applyInPandas(choose, "query_id long, rank int, doc_id long, mmr double")


def top_up(hits: DataFrame, least: int) -> DataFrame:
    """Fewer hits than least: repeat the list in score order; copy says which repetition, fallback whether it is one."""
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    ranked = hits.withColumns({"n": n, "pos": F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))})
    copies = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.lit(least) / F.col("n")) - 1, F.lit(0)).cast("int"))))
    out = copies.withColumn("rank", (F.col("copy") * F.col("n") + F.col("pos")).cast("long")).where((F.col("rank") <= least) | (F.col("copy") == 0))
    return out.select("query_id", "doc_id", "score", "rank", (F.col("copy") > 0).alias("fallback"))


def top_up_variant(hits: DataFrame, least: int, how: str = "score", seed: int = 42) -> DataFrame:
    """``top_up`` in another order: by score, by the order of the hits (rank), by a seeded hash (random), or in levels.

    Levels: hits of at least half of their query's best score first, by score, then the others by their rank.
    """
    best = F.max("score").over(W.partitionBy("query_id"))
    upper = F.col("score") >= best / 2
    orders = {
        "score": [F.desc("score")],
        "original": [F.asc("rank")],
        "random": [F.xxhash64(F.lit(seed), "query_id", "doc_id")],
        "levels": [F.desc("_upper"), F.when(F.col("_upper"), -F.col("score")).otherwise(F.col("rank").cast("double"))],
    }
    if how not in orders:
        raise ValueError(f"how is one of {sorted(orders)}")
    marked = hits.withColumn("_upper", upper)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*orders[how], "doc_id"))
    placed = marked.select("query_id", "doc_id", "score", (-place.cast("double")).alias("place"))
    filled = top_up(placed.select("query_id", "doc_id", F.col("place").alias("score")), least)
    return filled.withColumnRenamed("score", "place").join(placed, ["query_id", "doc_id", "place"]).select("query_id", "doc_id", "score", "rank", "fallback")


def query_relevance(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """hits (query_id, doc_id, embedding) whose score is the cosine of the document's and the query's (qv) vectors; 0 for zero vectors."""
    both = hits.drop("score").join(queries.select("query_id", "qv"), "query_id")
    length = norm(F.col("embedding")) * norm(F.col("qv"))
    return both.withColumn("score", F.when(length > 0, F.round(dot(F.col("embedding"), F.col("qv")) / length, 6)).otherwise(0.0)).drop("qv")


def check_parameters(values: dict, schema: dict[str, dict]) -> list[str]:
    """What is wrong with parameters by their schema: type (float, integer, boolean, string), min, max and options; [] if nothing."""
    kinds = {"float": (int, float), "integer": int, "boolean": bool, "string": str}
    wrong = []
    for name in schema.keys() & values.keys():
        want, v = schema[name], values[name]
        if not isinstance(v, kinds[want["type"]]) or isinstance(v, bool) and want["type"] != "boolean":
            wrong.append(f"{name} must be of type {want['type']}")
            continue
        if want["type"] in ("float", "integer") and not want.get("min", v) <= v <= want.get("max", v):
            wrong.append(f"{name} must be within {want.get('min')} and {want.get('max')}")
        if "options" in want and v not in want["options"]:
            wrong.append(f"{name} must be one of {want['options']}")
    return sorted(wrong)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(keep, copies): texts that occur more than once, by the smallest id, without gathering a group."""
    return docs.where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("keep", "copies")


def score_summary(hits: DataFrame) -> DataFrame:
    """(query_id, n, least, most, mean, kind): kind is dense, hybrid or sparse by the range of the query's scores, else generic."""
    s = F.col("score").cast("double")
    out = hits.groupBy("query_id").agg(F.count(s).alias("n"), F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.avg(s), 6).alias("mean"))
    lo, hi = F.col("least"), F.col("most")
    return out.withColumn("kind", F.when((lo >= -1) & (hi <= 1), "dense").when((lo < -100) | (hi > 100), "hybrid").when((lo >= 0) & (hi > 1), "sparse").otherwise("generic"))


def reorder(selected: DataFrame, by: str = "relevance", reverse: bool = False) -> DataFrame:
    """Selected hits (query_id, doc_id, score, embedding) ranked anew by score, or by diversity: 1 - mean cosine to the selection.

    The mean cosine is the inner product with the mean unit vector, so no pairs are made.
    """
    if by == "relevance":
        value = selected.withColumn("value", F.col("score").cast("double"))
    elif by == "diversity":
        unit = selected.withColumn("unit", normalised(F.col("embedding")))
        axis = unit.select("query_id", F.posexplode("unit").alias("i", "x")).groupBy("query_id", "i").agg(F.avg("x").alias("m"))
        mean = axis.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
        value = unit.join(mean, "query_id").withColumn("value", F.round(1 - dot(F.col("unit"), F.col("mean")), 6))
    else:
        raise ValueError("by is relevance or diversity")
    order = W.partitionBy("query_id").orderBy(F.asc("value") if reverse else F.desc("value"), "doc_id")
    return value.select("query_id", "doc_id", "value", F.row_number().over(order).alias("rank"))


def fallback_statistics(topped: DataFrame) -> DataFrame:
    """One row over the output of ``top_up``: queries, those that needed it, and rows that it added."""
    q = topped.groupBy("query_id").agg(F.sum(F.col("fallback").cast("long")).alias("added"))
    return q.agg(F.count(F.lit(1)).alias("queries"), F.sum((F.col("added") > 0).cast("long")).alias("fallbacks"), F.sum("added").alias("added"))
