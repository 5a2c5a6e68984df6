"""Quality and integrity profile of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uniqueness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, distinct values, values that repeat, rows in repeats and the share of distinct values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), (F.hex(c) if dict(rows.dtypes)[c] == "binary" else F.col(c).cast("string")).alias("v")) for c in columns])).alias("p")
    counts = rows.select(pairs).select("p.column_name", "p.v").filter("v is not null").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    repeat = F.col("n") > 1
    out = counts.groupBy("column_name").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.count_if(repeat).alias("n_repeated"), F.coalesce(F.sum(F.when(repeat, F.col("n"))), F.lit(0)).alias("rows_repeated"))
    return out.withColumn("unique_ratio", F.round(F.col("n_distinct") / F.col("n_rows"), 6))


def top_values(rows: DataFrame, value, name: str, k: int | None) -> DataFrame:
    """Most frequent values; nulls do not count, ties go by value."""
    counts = rows.select(value.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counts if k is None else counts.orderBy(F.col("n").desc(), name).limit(k)


def top_resolutions(images: DataFrame, k: int = 5) -> DataFrame:
    return images.groupBy("width", "height").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "width", "height").limit(k)


def invalid_images(blobs: DataFrame) -> DataFrame:
    bad = (F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("file_size") <= 0)
    return blobs.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_invalid"), F.count_if(F.col("width").isNull() | F.col("height").isNull()).alias("n_missing"))


def orphan_members(images: DataFrame, sequence_images: DataFrame) -> DataFrame:
    """Images in no sequence. The bridge's key is never null, so a plain anti-join is right."""
    return images.select("id").join(sequence_images.select(F.col("image_id").alias("id")), "id", "left_anti")


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of two stores: sizes of both, what only one has and what both have."""
    l, r = left.select("id").distinct().withColumn("l", F.lit(1)), right.select("id").distinct().withColumn("r", F.lit(1))
    both = l.join(r, "id", "full_outer")
    return both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"))


def members_per_sequence(sequence_images: DataFrame) -> DataFrame:
    return sequence_images.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_images"))
