"""Shared helpers of the corpus operators: shared storage, hashing and tables.

Nothing here keeps data in a machine-local folder on a cluster: intermediate
tables go to the folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_dir

__all__ = ["BROADCAST_KEYS", "BoundedCache", "is_held_out", "is_training", "join_by_size", "materialise", "mix64", "semi_by_size", "shared_dir", "table"]

#: Keys are broadcast only up to this many 8-byte values (8 MB); beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000


def semi_by_size(df: DataFrame, keys: DataFrame, col: str, n_keys: int) -> DataFrame:
    """Rows of `df` whose `col` is in the one-column `keys`: by broadcast if `n_keys` is small enough, else by shuffle."""
    right = F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys.hint("shuffle_merge")
    return df.join(right, col, "left_semi")


def join_by_size(df: DataFrame, small: DataFrame, on: str | list[str], n_small: int, how: str = "inner") -> DataFrame:
    """`df` joined to the right side `small`, broadcast if its `n_small` rows are few enough, else by shuffle."""
    return df.join(F.broadcast(small) if n_small <= BROADCAST_KEYS else small.hint("shuffle_merge"), on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_training(doc_id) -> object:
    """crc32 of the id as text modulo 5 is not 0; a null id trains nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def is_held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche over uint64 (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class BoundedCache(dict):
    """word -> value made on first use; emptied when it holds `most` words, so its memory is bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value
