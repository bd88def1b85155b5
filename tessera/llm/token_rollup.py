"""Token counts as rollups maintained by deltas.

Changes are signed: an insert adds a document's tokens to its (source, lang, tokenizer) total, a delete takes them
away, a revision takes the old count away and adds the new one. A batch is summed to one row for each key and
staged in a new folder, which is then renamed to the batch's identifier in one step (where the file system renames folders in one step, as
object stores don't): a crash leaves the batch whole or not there,
and a batch that is there already is refused, so a retry never counts twice. Totals are the sums over all committed
batches; ``compact`` folds batches into one base that remembers their identifiers (one name a batch), and such
batches are refused as well.

Counts are additive, so batches may come in any order and keys may hold any share of all rows: sums combine before
the shuffle. Rows: null and empty texts have 0 tokens, long ones are read whole; null keys are groups of their own; repeated rows
count each; an empty batch commits and changes nothing; keys whose documents and tokens are both 0 stay out of the totals. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import uuid
from functools import cache
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(path: str, pattern: str):
    """A function from a text column to its number of tokens by a rank file that every executor has at the path."""

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        enc = _encoding(path, pattern)
        return pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in text.to_pylist()], pa.int64())

    return lambda col: count(col.cast("string"))


def inserts(docs: DataFrame, tokens: Column, tokenizer: str) -> DataFrame:
    """Documents as changes of kind insert."""
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit("insert").alias("kind"), tokens.alias("tokens"), F.lit(0).cast("long").alias("old_tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """One row for each key from (source, lang, tokenizer, kind, tokens, old_tokens); kind: insert, delete or revise.

    A delete takes ``tokens`` away; a revision adds ``tokens`` and takes ``old_tokens`` away.
    """
    kind, new, old = F.col("kind"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0)
    tokens = F.when(kind == "insert", new).when(kind == "delete", -new).when(kind == "revise", new - old)
    return changes.where(kind.isin("insert", "delete", "revise")).groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("documents"), F.sum(tokens).cast("long").alias("tokens"))


class Rollup:
    """Committed batches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{kind}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if fs.exists(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes. False, and no further effect, if its identifier is committed."""
        name = "batch-" + quote(batch, safe="")
        target, fs = self._fs(f"{self.path}/batches/{name}")
        if fs.exists(target) or name in self._compacted():
            return False
        staged, _ = self._fs(f"{self.path}/staged/{name}-{uuid.uuid4().hex}")
        deltas(changes).write.parquet(staged.toString())
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, True)
            return False
        return True

    def _base(self) -> str | None:
        return max(self._names("base"), default=None)

    def _compacted(self) -> set[str]:
        base = self._base()
        return set() if base is None else {r[0] for r in self.spark.read.parquet(f"{self.path}/base/{base}/names").collect()}

    def _listing(self) -> tuple[str | None, set[str], list[str]]:
        """The base, the batches that it holds, and the committed ones beside it, as they are now."""
        base, old = self._base(), self._compacted()
        return base, old, [n for n in self._names("batches") if n not in old]

    def _sums(self, base: str | None, beside: list[str]) -> DataFrame:
        parts = [f"{self.path}/batches/{n}" for n in beside] + ([f"{self.path}/base/{base}/totals"] if base else [])
        rows = self.spark.read.schema(_DELTA).parquet(*parts) if parts else self.spark.createDataFrame([], _DELTA)
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches."""
        base, _, beside = self._listing()
        return self._sums(base, beside)

    def compact(self) -> None:
        """Fold all batches into a new base; it counts once its last file is written.

        Totals and names are of one listing, so a batch that another writer commits meanwhile stays beside the base and counts once.
        """
        base, old, beside = self._listing()
        names = sorted(old | set(beside))
        path = f"{self.path}/base/{0 if base is None else int(base) + 1:09d}"
        self._sums(base, beside).write.mode("overwrite").parquet(f"{path}/totals")
        self.spark.createDataFrame([(n,) for n in names], "name string").write.mode("overwrite").parquet(f"{path}/names")
        p, fs = self._fs(f"{path}/_SUCCESS")
        fs.create(p).close()
