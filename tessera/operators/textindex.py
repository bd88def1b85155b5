"""A stored inverted index: written once, extended by segments, merged, and searched without reading the documents again.

A posting is a row (term, layer, doc_id, dl, tf, positions), sorted by (bucket, term, layer) and kept in a folder for each bucket
of terms, so that a search reads the buckets and row groups of its terms only. ``layer`` is the posting's saturated frequency in
sixteenths at a fixed length, so a term's layers fall in score; each layer's greatest frequency and smallest length are stored, which
bound its scores for any parameters and mean length (block maxima). A segment is one batch of documents; the manifest names the live
segments, and a new version of it, which is created by one writer only, makes a batch or a merge visible as a whole.

Search is by maximal scores and exact. First the highest of the layers with few documents give some documents a query, whose full
scores give a least score that the k best reach. Terms whose bounds together stay below it can't bring a document in; of the other
terms only the layers that could are read. The documents that these leave are scored in full.

Rows: null, empty and token-free texts and null ids are no documents; of rows with one id that is new, the one with the smallest text is taken;
an id that the index holds already stays as it is. Terms of any share of the documents are many rows, dealt by ranges of (term, layer, id).
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import bounded, cut, fits, shared_dir
from . import lexical
from .lexical import Tokenizer, saturation, term_counts, top_k

LAYERS = 16
#: Length at which layers are told apart; any value gives right results.
LAYER_LENGTH, LAYER_K1 = 256, 1.5
#: Distinct terms of a query batch up to which they are pushed into the scan, to skip buckets and row groups; beyond, they are joined.
PUSHED_TERMS = 64
_POSTING = "term string, layer int, doc_id long, dl int, tf int, positions array<int>, bucket int"


class TextIndex:
    """The index below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer = tokens) -> None:
        self.spark, self.path, self.tokenizer = spark, path.rstrip("/"), tokenizer
        self._version, self._manifest = self._latest()

    # -- files ---------------------------------------------------------------------------------------------------------

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, dict]:
        """The last manifest that is written to its end."""
        p, fs = self._at("manifest")
        names = sorted((s.getPath().getName() for s in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
        for name in (n for n in names if n.endswith(".json")):
            text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{name}").collect())
            try:
                return int(name.split(".")[0]), json.loads(text)
            except json.JSONDecodeError:
                continue
        return 0, {"segments": [], "parameters": {}}

    def _commit(self, manifest: dict) -> None:
        """Make a manifest the newest one; refused if another writer was first."""
        p, fs = self._at(f"manifest/{self._version + 1:09d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise RuntimeError("another writer changed the index; open it again") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._version, self._manifest = self._version + 1, manifest

    def _segments(self, kind: str) -> list[str]:
        return [f"{self.path}/segments/{s['name']}/{kind}" for s in self._manifest["segments"]]

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = self._segments(kind)
        if not paths:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # -- writing -------------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, tokenizer: Tokenizer = tokens, variant: str = "okapi", k1: float = 1.5, b: float = 0.75, buckets: int = 32) -> TextIndex:
        """An empty index with its default parameters; an index that is there already is refused."""
        new = cls(spark, path, tokenizer)
        if new._version:
            raise ValueError(f"{path} holds an index")
        new._commit({"segments": [], "parameters": {"variant": variant, "k1": k1, "b": b, "buckets": buckets}})
        return new

    @classmethod
    def open(cls, spark: SparkSession, path: str, tokenizer: Tokenizer = tokens) -> TextIndex:
        found = cls(spark, path, tokenizer)
        if not found._version:
            raise ValueError(f"{path} holds no index")
        return found

    @property
    def parameters(self) -> dict:
        return dict(self._manifest["parameters"])

    def _fresh(self, docs: DataFrame) -> DataFrame:
        """Documents whose id is new, one row each; texts are compared for repeated ids only."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
        again = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
        if not again.isEmpty():
            once = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
            rows = rows.join(again, "doc_id", "left_anti").unionByName(once)
        return rows.join(self.documents().select("doc_id"), "doc_id", "left_anti") if self._manifest["segments"] else rows

    def _write(self, rows: DataFrame) -> dict:
        """A segment of postings (doc_id, dl, term, tf, positions), not yet live."""
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        share = F.col("tf") / (F.col("tf") + LAYER_K1 * (0.25 + 0.75 * F.col("dl") / LAYER_LENGTH))
        rows = rows.withColumns({"layer": F.floor(share * LAYERS).cast("int"), "bucket": F.pmod(F.xxhash64("term"), F.lit(self.parameters["buckets"])).cast("int")})
        order = ["bucket", "term", F.desc("layer"), "doc_id"]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*[c.split()[0] for c in _POSTING.split(", ")]).write.partitionBy("bucket").parquet(f"{at}/postings")
        written = self.spark.read.schema(_POSTING).parquet(f"{at}/postings")
        blocks = written.groupBy("term", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("freq"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
        blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.parameters["buckets"])).cast("int")).sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{at}/layers")
        # a document is known by the posting of its first token
        first = written.where("tf > 0 and positions[0] = 0").select("doc_id", "dl")
        first.write.parquet(f"{at}/documents")
        n, total = self.spark.read.schema("doc_id long, dl int").parquet(f"{at}/documents").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"name": name, "documents": n, "tokens": total}

    def add(self, docs: DataFrame) -> int:
        """Add a batch (doc_id, text) as a segment; the number of documents that were new and have tokens."""
        bag = self._fresh(docs).select("doc_id", self.tokenizer(F.col("text")).alias("t")).where(F.size("t") > 0)
        each = bag.select("doc_id", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term"))
        rows = each.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
        return self._live(self._write(rows))

    def force_terms(self, terms: list[str]) -> int:
        """Terms that no document has become those of one document without id, which counts for the statistics and is never found."""
        known = {r[0] for r in self.terms().where(F.col("term").isin(list(terms))).select("term").collect()} if terms else set()
        missing = sorted(set(terms) - known)
        if not missing:
            return 0
        rows = self.spark.createDataFrame([(None, len(missing), t, 1, [i]) for i, t in enumerate(missing)], "doc_id long, dl int, term string, tf int, positions array<int>")
        return self._live(self._write(rows))

    def _live(self, segment: dict) -> int:
        if segment["documents"]:
            self._commit({**self._manifest, "segments": [*self._manifest["segments"], segment]})
        return segment["documents"]

    def merge(self) -> None:
        """Write all segments as one; searches of the old ones go on, as their files stay until ``clean``."""
        if len(self._manifest["segments"]) > 1:
            merged = self._write(self._read("postings", _POSTING).drop("layer", "bucket"))
            self._commit({**self._manifest, "segments": [merged]})

    def clean(self) -> None:
        """Delete segments that the newest manifest doesn't name; for when no search of an older one is running."""
        p, fs = self._at("segments")
        live = {s["name"] for s in self._manifest["segments"]}
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName() not in live:
                fs.delete(s.getPath(), True)

    # -- reading -------------------------------------------------------------------------------------------------------

    def documents(self) -> DataFrame:
        """(doc_id, dl) of all documents."""
        return self._read("documents", "doc_id long, dl int")

    def wanted(self, asked: DataFrame) -> dict[str, int] | None:
        """The terms (term) that a batch asks for and their buckets; none if they are more than a scan's filter takes."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.parameters["buckets"])).cast("int")
        found = {t: b for t, b in asked.select("term").distinct().select("term", bucket).limit(PUSHED_TERMS + 1).collect()}
        return found if len(found) <= PUSHED_TERMS else None

    def postings(self, terms: dict[str, int] | None = None) -> DataFrame:
        """(term, layer, doc_id, dl, tf, positions), of some terms (``wanted``) only by their buckets and row groups."""
        return self._pruned(self._read("postings", _POSTING), terms)

    def layers(self, terms: dict[str, int] | None = None) -> DataFrame:
        """(term, layer, n, freq, max_tf, min_dl) over all segments."""
        rows = self._pruned(self._read("layers", "term string, layer int, n long, freq long, max_tf int, min_dl int, bucket int"), terms)
        if len(self._manifest["segments"]) == 1:
            return rows
        return rows.groupBy("term", "layer").agg(F.sum("n").alias("n"), F.sum("freq").alias("freq"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))

    def _pruned(self, rows: DataFrame, terms: dict[str, int] | None) -> DataFrame:
        if terms is not None:
            rows = rows.where(F.col("bucket").isin(sorted(set(terms.values()))) & F.col("term").isin(list(terms)))
        return rows.drop("bucket")

    def size(self) -> tuple[int, float | None]:
        """Documents with tokens and their mean length."""
        n, total = (sum(s[c] for s in self._manifest["segments"]) for c in ("documents", "tokens"))
        return n, total / n if n else None

    def terms(self) -> DataFrame:
        """(term, df, freq) of the vocabulary."""
        return self.layers().groupBy("term").agg(F.sum("n").alias("df"), F.sum("freq").alias("freq"))

    def corpus(self) -> DataFrame:
        """The statistics in the form of ``lexical.corpus``: (term, df, freq), and the row without a term."""
        totals = [(None, *(sum(s[c] for s in self._manifest["segments"]) for c in ("documents", "tokens")))]
        return self.terms().unionByName(self.spark.createDataFrame(totals if totals[0][1] else [], "term string, df long, freq long"))

    def stats(self, variant: str | None = None) -> DataFrame:
        """(term, df, idf) of the vocabulary, written once for each manifest and variant."""
        variant = variant or self.parameters["variant"]
        path = f"stats/{self._version:09d}-{variant}"
        done, fs = self._at(f"{path}/_SUCCESS")
        if not fs.exists(done):
            lexical.term_stats(self.corpus(), variant).write.mode("overwrite").parquet(f"{self.path}/{path}")
        return self.spark.read.schema("term string, df long, idf double").parquet(f"{self.path}/{path}")

    def weights(self, variant: str | None = None, k1: float | None = None, b: float | None = None) -> DataFrame:
        """(doc_id, term, weight): the sparse vectors of all documents in long form."""
        stats = self.stats(variant)
        rows = self.postings().where("doc_id is not null").drop("positions", "layer").withColumn("avgdl", F.lit(self.size()[1]))
        return rows.join(bounded(stats), "term").select("doc_id", "term", (F.col("idf") * self._saturation(k1, b)).alias("weight"))

    def _saturation(self, k1: float | None, b: float | None) -> Column:
        p = self.parameters
        return saturation(p["k1"] if k1 is None else k1, p["b"] if b is None else b)

    # -- search --------------------------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int = 10, variant: str | None = None, k1: float | None = None, b: float | None = None) -> DataFrame:
        """The k best documents of each query (query_id, text) by BM25: (query_id, doc_id, score, rank)."""
        asked = term_counts(queries, "query_id", "text", "qtf", self.tokenizer)
        stats = self.stats(variant)
        return self.best(asked.join(stats, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("factor")), k, k1, b)

    def best(self, factors: DataFrame, k: int = 10, k1: float | None = None, b: float | None = None) -> DataFrame:
        """The k best by the sum of factor times saturated frequency over (query_id, term, factor), one row for each term of a query."""
        factors = cut(factors)
        wanted = self.wanted(factors)
        post = self.postings(wanted).where("doc_id is not null").drop("positions").withColumn("avgdl", F.lit(self.size()[1]).cast("double"))
        part = self._saturation(k1, b) * F.col("factor")

        # bounds of each layer of each query term, of its term, and of the query's terms up to it from the lowest
        upper = F.greatest(F.lit(0.0), F.col("factor") * self._bound(k1, b))
        each = W.partitionBy("query_id")
        plan = factors.join(self.layers(wanted), "term").withColumn("upper", upper)
        plan = cut(plan.withColumn("peak", F.max("upper").over(W.partitionBy("query_id", "term"))))
        # all that is made of the plan without postings is smaller than the plan
        small = F.broadcast if fits(plan) else (lambda df: df)

        by_term = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        by_doc = plan.select("term", "layer", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / max(1, self.size()[0])

        def full(candidates: DataFrame) -> DataFrame:
            """Full scores of (query_id, doc_id), by the join that makes fewer rows first; other documents' postings go before anything is shuffled."""
            if candidates.count() * by_doc < by_term:
                met = post.join(bounded(candidates), "doc_id").join(small(factors), ["query_id", "term"])
            else:
                met = post.join(small(factors), "term").join(bounded(candidates), ["query_id", "doc_id"])
            return met.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))

        before = F.sum("n").over(each.orderBy(F.desc("upper"), "term", F.desc("layer")).rowsBetween(W.unboundedPreceding, -1))
        start = plan.where(F.col("n") <= 8 * k).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 4 * k).select("query_id", "term", "layer")
        some = cut(post.join(small(start), ["term", "layer"]).select("query_id", "doc_id").distinct())
        least = top_k(full(some), k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
        terms = plan.select("query_id", "term", "peak").distinct()
        below = terms.withColumn("below", F.sum("peak").over(each.orderBy("peak", "term"))).withColumn("total", F.sum("peak").over(each))
        # a bound may be missed by what rounding adds
        left = cut(below.join(least, "query_id", "left").withColumn("least", F.coalesce(F.col("least") - 2e-6, F.lit(float("-inf")))))
        needed = left.where("below >= least").drop("peak").join(plan, ["query_id", "term"]).where("total - peak + upper >= least")
        rest = left.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("below") < F.col("least"), F.col("peak"))), F.lit(0.0)).alias("rest"), F.max("least").alias("least"))
        met = post.join(small(needed.select("query_id", "term", "layer", "factor")), ["term", "layer"])
        # what lowers a score doesn't count for its bound
        sums = met.groupBy("query_id", "doc_id").agg(F.sum(F.greatest(F.lit(0.0), part)).alias("have"))
        found = sums.join(small(rest), "query_id").where("have + rest >= least").select("query_id", "doc_id")
        return top_k(full(cut(found)), k)

    def _bound(self, k1: float | None, b: float | None) -> Column:
        """The saturated frequency of a layer at its greatest frequency and smallest length."""
        p, avgdl = self.parameters, self.size()[1] or 1.0
        k1, b = p["k1"] if k1 is None else k1, p["b"] if b is None else b
        return F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_dl") / avgdl))

    def phrases(self, queries: DataFrame, slop: int = 0) -> DataFrame:
        """(query_id, doc_id, times): documents that hold the tokens of the query's text in order, at most ``slop`` tokens further apart in all.

        ``times`` counts the places of the first token from which the phrase goes on. Only documents with all of the terms are looked into, and
        there only places from which each term stands within reach.
        """
        t = queries.select("query_id", self.tokenizer(F.col("text")).alias("t")).where(F.size("t") > 0)
        asked = cut(t.select("query_id", F.size("t").alias("length"), F.size(F.array_distinct("t")).alias("distinct"), F.posexplode("t").alias("i", "term")))
        post = self.postings(self.wanted(asked)).where("doc_id is not null").select("term", "doc_id", "positions")
        has = post.select("term", "doc_id").join(bounded(asked.select("query_id", "term", "distinct").distinct()), "term")
        all_of = cut(has.groupBy("query_id", "doc_id", "distinct").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("distinct")).select("query_id", "doc_id"))
        met = post.join(bounded(all_of), "doc_id").join(bounded(asked.select("query_id", "term", "i")), ["query_id", "term"])
        # places from which token i would begin the phrase without gaps
        begins = F.transform("positions", lambda p: p - F.col("i"))
        rows = met.select("query_id", "doc_id", F.struct("i", begins.alias("d")).alias("x")).groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        reach = lambda d: F.flatten(F.transform(d, lambda p: F.sequence(p - slop, p))) if slop else d
        likely = F.aggregate(F.slice("xs", 2, F.size("xs")), F.get("xs", F.lit(0))["d"], lambda have, x: F.array_intersect(have, reach(x["d"])))
        last = lambda start, xs: F.aggregate(xs, start, lambda at, x: F.array_min(F.filter(x["d"], lambda p: p >= at)))
        rows = rows.select("query_id", "doc_id", "xs", likely.alias("starts")).where(F.size("starts") > 0)
        fits = F.filter("starts", lambda p: last(p, F.col("xs")) <= p + slop) if slop else F.col("starts")
        return rows.select("query_id", "doc_id", F.size(fits).cast("long").alias("times")).where("times > 0")


def stored(docs: DataFrame, tokenizer: Tokenizer = tokens, name: str = "words") -> TextIndex:
    """The index of the files that docs (doc_id, text) reads, built in the shared folder when it isn't there yet."""
    spark = docs.sparkSession
    key = hashlib.sha256("\n".join([name, *sorted(docs.inputFiles())]).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/text-index-{key}"
    found = TextIndex(spark, path, tokenizer)
    if not found._version:
        found = TextIndex.create(spark, path, tokenizer)
    if not found._manifest["segments"]:
        found.add(docs)
    return found


def verbatim(index: TextIndex, docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents that hold a passage (query_id, text) verbatim, led to by the index.

    A passage's words but the first and last are whole tokens of a text that holds it, so they are a phrase there; the few documents that have it
    are compared. Passages of fewer than three tokens meet every document.
    """
    q = cut(passages.select("query_id", F.col("text").alias("q")).where("q is not null").withColumn("t", index.tokenizer(F.col("q"))))
    inner = q.where(F.size("t") >= 3).select("query_id", F.array_join(F.slice("t", 2, F.size("t") - 2), " ").alias("text"))
    led = cut(index.phrases(inner).select("query_id", "doc_id"))
    few = docs.join(bounded(led.select("doc_id").distinct()), "doc_id", "left_semi")
    found = few.join(bounded(led), "doc_id").join(bounded(q.select("query_id", "q")), "query_id").where(F.expr("contains(text, q)")).select("query_id", "doc_id")
    short = q.where(F.size("t") < 3).select("query_id", "q")
    if short.isEmpty():
        return found
    return found.unionAll(docs.join(bounded(short), F.expr("contains(text, q)")).select("query_id", "doc_id"))
