"""Code-point arrays of many texts at once, and the bounded samples that models are fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line ends between texts, so that no n-gram of up to this length spans two of them.
PAD = 4


def batches(col: pa.Array, most: int = 1 << 18, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, starts) of as many texts as fit in so many characters, or one longer text.

    Each text, and the front of the first, is followed by PAD line ends; starts has one more entry than texts.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.utf8_length(col), 0)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    i, pad = 0, "\n" * PAD
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
        texts = [t or "" for t in col.slice(i, j - i).to_pylist()]
        if lower:
            texts = [t.lower() for t in texts]
        starts = np.concatenate([[PAD], PAD + np.cumsum([len(t) + PAD for t in texts])]).astype(np.int64)
        yield i, np.frombuffer((pad + pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32), starts
        i = j


def share_of(key: Column, share: Column | float, seed: int) -> Column:
    """True for a seeded share of the keys, alike wherever and whenever it is computed."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))
    return u < share


def sample_by_group(df: DataFrame, group: str, key: str, most: int, seed: int, groups: int = 256) -> DataFrame:
    """About ``most`` rows of each of the ``groups`` largest groups, chosen by a seeded hash of the key; one row a group reaches the driver."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.orderBy(F.desc("n"), group).limit(groups).collect()
    wanted = F.lit(False)
    for row in sorted(counts, key=lambda r: str(r[0])):
        wanted = F.when(F.col(group) == F.lit(row[0]), share_of(F.col(key), most / row["n"], seed)).otherwise(wanted)
    return df.where(wanted)
