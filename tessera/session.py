"""Session defaults and table access."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; cluster settings come from the environment."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Spark's reader prunes columns and pushes filters down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which a table is sent to all executors; beyond, joins shuffle.
BROADCAST_BYTES = 48 << 20
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8}


def _bytes(c: str, kind: str) -> Column:
    """The size of a value: numbers by their type, texts by their bytes, arrays of numbers by their length, others as text."""
    col = F.col(f"`{c}`")
    if kind in _WIDTHS:
        return F.lit(_WIDTHS[kind])
    if kind.startswith("array<") and kind[6:-1] in _WIDTHS:
        return F.size(col) * _WIDTHS[kind[6:-1]] + 16
    text = col if kind in ("string", "binary") else F.to_json(F.struct(col))
    return F.octet_length(text) + 16


def fits(df: DataFrame, rows: int = 1_000_000, most: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most ``rows`` rows and ``most`` bytes, which are counted up to that bound."""
    size = reduce(lambda a, b: a + b, [F.coalesce(_bytes(c, k), F.lit(0)) for c, k in df.dtypes], F.lit(16))
    n, total = df.select(size.cast("long").alias("b")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and total <= most


def bounded(df: DataFrame, rows: int = 1_000_000, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint when it ``fits``; else as it is."""
    return F.broadcast(df) if fits(df, rows, most) else df


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode without one, a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once however often it is used, and safe from lost executors.

    The folder is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
