"""Tables in hash buckets that outlive their session.

A table is a folder of Parquet files, split by generation and, inside, into buckets of one
column. Joins and co-groups by that column read it bucket by bucket, so only the other side is
shuffled. The catalog entry is made anew from the folder by whoever opens it, and a generation
counts only once its owner's manifest names it, so a write that broke off is never read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import delete, exists


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, columns: str, by: str, buckets: int, ordered: bool = False):
        """``columns`` as in a DDL schema with ", " between columns only, ``by`` the bucket column, by which
        the rows of a file are sorted where ``ordered``."""
        self.spark, self.path, self.by, self.buckets = spark, path, by, buckets
        self.name = f"prismloom_{hashlib.md5(path.encode()).hexdigest()[:20]}"
        self._names = [c.split()[0] for c in columns.split(", ")]
        spark.sql(f"create table if not exists {self.name} ({columns}, gen bigint) using parquet partitioned by (gen) clustered by ({by}){f' sorted by ({by})' if ordered else ''} into {buckets} buckets location '{path}'")
        if exists(spark, path):
            spark.catalog.recoverPartitions(self.name)

    def append(self, rows: DataFrame, gen: int | None = None) -> None:
        """Add a generation, or those that a column ``gen`` names; rows that are not yet in buckets are
        shuffled into them by the caller."""
        number = F.col("gen") if gen is None else F.lit(gen)
        rows.select(*self._names, number.cast("long").alias("gen")).write.insertInto(self.name)

    def read(self, gens: list[int], keep_gen: bool = False) -> DataFrame:
        rows = self.spark.table(self.name).filter(F.col("gen").isin(gens))
        return rows if keep_gen else rows.drop("gen")

    def discard(self, gens: list[int]) -> None:
        """Delete generations that a newer one holds."""
        for gen in gens:
            self.spark.sql(f"alter table {self.name} drop if exists partition (gen = {gen})")
            delete(self.spark, f"{self.path}/gen={gen}")

    def close(self) -> None:
        """Take the entry out of the catalog; the folder stays."""
        self.spark.sql(f"drop table if exists {self.name}")


def _spread_bits(values: np.ndarray) -> np.ndarray:
    """Spark's hash of ints (32-bit Murmur3, seed 42)."""
    turn = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    k = turn(values.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).astype(np.int32)


@functools.lru_cache(maxsize=8)
def even_codes(n: int) -> tuple[int, ...]:
    """``n`` ints of which each falls into another one of ``n`` buckets, so that as many groups are
    as many even tasks; hashing their plain numbers would leave a third of the buckets empty."""
    found: dict[int, int] = {}
    start = 0
    while len(found) < n:
        values = np.arange(start, start + 8 * n, dtype=np.int64)
        for v, b in zip(values.tolist(), (_spread_bits(values).astype(np.int64) % n).tolist(), strict=True):
            found.setdefault(b, v)
        start += 8 * n
    return tuple(found[b] for b in range(n))
