"""Grouped statistics with an overall row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "Overall Total"


def with_total(rows: DataFrame, by: str, *aggregates: Column) -> DataFrame:
    """Aggregates per value of ``by`` and over all rows. Both the rows of a null group and
    the overall row are labelled; ``is_total`` tells them apart."""
    sets = rows.groupingSets([[F.col(by)], []], F.col(by))
    out = sets.agg(F.grouping(by).cast("int").alias("is_total"), *aggregates)
    return out.withColumn(by, F.coalesce(by, F.lit(TOTAL)))


def spread(name: str, value: Column, places: int | None = 2) -> list[Column]:
    return [
        F.round(F.avg(value), places).alias(f"avg_{name}"),
        F.min(value).alias(f"min_{name}"),
        F.max(value).alias(f"max_{name}"),
        F.median(value).alias(f"median_{name}"),
        F.round(F.stddev_samp(value), places).alias(f"std_{name}"),
    ]


def image_stats(images: DataFrame) -> DataFrame:
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    area, aspect = w * h, w / h
    return with_total(
        images.filter("height > 0"),
        "source",
        F.count(F.lit(1)).alias("n_images"),
        *spread("width", w),
        *spread("height", h),
        F.round(F.avg(area), 0).alias("avg_area"),
        F.min(area).alias("min_area"),
        F.max(area).alias("max_area"),
        F.median(area).alias("median_area"),
        F.round(F.avg(aspect), 2).alias("avg_aspect"),
        F.round(F.median(aspect), 2).alias("median_aspect"),
    )


def text_stats(texts: DataFrame) -> DataFrame:
    return with_total(texts, "source", F.count(F.lit(1)).alias("n_texts"), *spread("length", F.length("content").cast("double")))


def sequence_stats(sequences: DataFrame, sequence_images: DataFrame, sequence_texts: DataFrame) -> DataFrame:
    """Members per sequence, each bridge counted on its own before the join, so that images and
    texts never multiply."""
    n_img = sequence_images.groupBy("sequence_id").agg(F.count_distinct("image_id").alias("n_img"))
    n_txt = sequence_texts.groupBy("sequence_id").agg(F.count_distinct("text_id").alias("n_txt"))
    joined = sequences.select(F.col("id").alias("sequence_id"), "source").join(n_img, "sequence_id", "left").join(n_txt, "sequence_id", "left").na.fill(0, ["n_img", "n_txt"])
    img, txt = F.col("n_img").cast("double"), F.col("n_txt").cast("double")
    return with_total(joined, "source", F.count(F.lit(1)).alias("n_sequences"), F.sum("n_img").alias("sum_images"), *spread("images", img), F.sum("n_txt").alias("sum_texts"), *spread("texts", txt))


def distinct_sources(rows: DataFrame) -> DataFrame:
    return rows.select("source").filter("source is not null and source <> ''").distinct()


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, quartiles (exact, linear) and range of each column, one row per column."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("p")
    long = rows.select(values).select("p.column_name", "p.v").filter("v is not null and not isnan(v)")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy("column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q.alias("q"), F.max("v").alias("max"))
    return out.select("column_name", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", F.round(F.col("q")[0], 4).alias("p25"), F.round(F.col("q")[1], 4).alias("p50"), F.round(F.col("q")[2], 4).alias("p75"), "max")


#: Right-closed buckets of members per sequence.
COUNT_BINS = ((0, 1), (1, 5), (5, 10), (10, 20), (20, 50), (50, None))


def count_histogram(counts: DataFrame, column: str) -> DataFrame:
    """Rows per bucket of COUNT_BINS, empty buckets included."""
    spark = counts.sparkSession
    bins = spark.createDataFrame([(i, f"({lo},{'inf' if hi is None else hi}]", float(lo), float("inf") if hi is None else float(hi)) for i, (lo, hi) in enumerate(COUNT_BINS)], "bin int, label string, lo double, hi double")
    which = F.when(F.col(column) <= COUNT_BINS[0][0], None)
    for i, (lo, hi) in enumerate(COUNT_BINS):
        which = which.when(F.col(column) <= hi, i) if hi is not None else which.otherwise(i)
    filled = counts.select(which.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(bins).join(filled, "bin", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def equal_width_histogram(rows: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Right-closed bins of equal width, the lowest widened by 0.1 % of the range; a constant
    column is spread by 0.1 % of its value to both sides. Nulls and NaN do not count."""
    v = F.col(column).cast("double")
    values = rows.select(v.alias("v")).filter("v is not null and not isnan(v)")
    limits = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    same = F.col("lo") == F.col("hi")
    pad = F.when(F.col("lo") != 0, 0.001 * F.abs("lo")).otherwise(0.001)
    limits = limits.select(F.when(same, F.col("lo") - pad).otherwise(F.col("lo")).alias("a"), F.when(same, F.col("hi") + pad).otherwise(F.col("hi")).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    placed = values.crossJoin(F.broadcast(limits)).select(F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col("v") - F.col("a")) / width))).cast("int").alias("bin"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
