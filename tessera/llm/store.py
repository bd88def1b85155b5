"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``.

Cutting the lineage with a written table computes a plan once (a reliable checkpoint computes it twice) and
survives lost executors, since every executor can read the files again.
"""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def lean_workers(spark: SparkSession) -> None:
    """Python workers that start from now on give freed arrays back to the system, where the caller set nothing else."""
    env = spark.sparkContext.environment
    for name, value in (("MALLOC_MMAP_THRESHOLD_", "4194304"), ("MALLOC_TRIM_THRESHOLD_", "8388608"), ("MALLOC_ARENA_MAX", "2"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(name, value)


def give_back() -> None:
    """Return the freed memory of this Python process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Scratch:
    """Tables of one operator call; ``drop`` removes those that later steps no longer read, the driver's end all others."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        lean_workers(spark)
        self.spark, self.base, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made}"
        df.write.parquet(path)
        if self.made == 1:
            p, fs = self._at(self.base)
            fs.deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            p, fs = self._at(t._scratch_path)
            fs.delete(p, True)


#: Bytes up to which a table is sent to all executors; beyond, joins shuffle.
BROADCAST_BYTES = 48 << 20
_WIDTHS = {"boolean": 1, "int": 4, "float": 4}


def sized(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a table whose counted rows stay under the bound, at 16 bytes a row and 8 a number; 256 for other values."""
    kinds = [t for _, t in df.dtypes]
    width = 16 + sum(_WIDTHS.get(t, 8 if t in ("bigint", "double", "timestamp") else 256) for t in kinds)
    return F.broadcast(df) if rows * width <= most else df


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value's text, modulo n; -1 for null."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(-1))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not use yet."""
    used = {c.lower() for c in df.columns}
    while stem.lower() in used:
        stem += "_"
    return stem


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The frame with new columns; an input column of the same name gives way."""
    lower = {k.lower() for k in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower], *[v.alias(k) for k, v in new.items()])
