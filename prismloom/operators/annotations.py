"""Analytics over sample annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _value() -> Column:
    """Float scores as doubles; NaN is no value."""
    v = F.col("value_float").cast("double")
    return F.when(~F.isnan(v), v)


def overview(annotations: DataFrame) -> DataFrame:
    v = _value()
    return annotations.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("creator_id").alias("n_creators"), F.count_distinct("sequence_id").alias("n_sequences"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.round(F.avg(v), 6).alias("avg_value"))


def value_stats(annotations: DataFrame, name: str) -> DataFrame:
    v = _value()
    return annotations.filter(F.col("name") == name).agg(F.count(v).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.round(F.avg(v), 6).alias("avg_value"), F.round(F.stddev_samp(v), 6).alias("std_value"))


def by_creator(annotations: DataFrame, creators: DataFrame, name: str) -> DataFrame:
    names = creators.select(F.col("id").alias("creator_id"), F.col("name").alias("creator_name"))
    v = _value()
    return annotations.filter(F.col("name") == name).join(names, "creator_id").groupBy("creator_name").agg(F.count(v).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.round(F.avg(v), 6).alias("avg_value"), F.round(F.stddev_samp(v), 6).alias("std_value"))


def score_by_source(annotations: DataFrame, elements: DataFrame, images: DataFrame, name: str) -> DataFrame:
    """Average score and count per source of the annotated images."""
    scored = annotations.filter(F.col("name") == name).select(F.col("id").alias("sample_annotation_id"), _value().alias("v"))
    on = elements.filter("element_type = 'image'").select("sample_annotation_id", F.col("element_id").alias("image_id"))
    return scored.join(on, "sample_annotation_id").join(images.select(F.col("id").alias("image_id"), "source"), "image_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("avg_value"))


def score_buckets(annotations: DataFrame, name: str, high: float = 0.8, medium: float = 0.6) -> DataFrame:
    v = _value()
    label = F.when(v > high, "High").when(v > medium, "Medium").otherwise("Low")
    return annotations.filter(F.col("name") == name).select(label.alias("bucket"), v.alias("v")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("avg_value"))


def top_scores(annotations: DataFrame, name: str, above: float, k: int) -> DataFrame:
    rows = annotations.filter(F.col("name") == name).select("id", "sequence_id", _value().alias("value")).filter(F.col("value") > above)
    return rows.orderBy(F.col("value").desc(), "id").limit(k)


def export(annotations: DataFrame, creators: DataFrame, elements: DataFrame, how: str = "inner") -> DataFrame:
    """A row per annotation and element ('inner'), or also annotations without elements ('left').
    NaN is no value here either and comes out as null, as CSV and JSON cannot tell it."""
    names = creators.select(F.col("id").alias("creator_id"), F.col("name").alias("creator_name"))
    on = elements.select(F.col("sample_annotation_id").alias("id"), "element_id", "element_type", "role")
    return annotations.join(names, "creator_id", how).join(on, "id", how).select("id", "name", "sequence_id", F.nullif("value_float", F.lit(float("nan")).cast("float")).alias("value_float"), "value_json", "creator_name", "element_id", "element_type", "role")


def annotated_twice(annotations: DataFrame, elements: DataFrame, first: tuple[str, float], second: tuple[str, float]) -> DataFrame:
    """Elements that score above both thresholds: two semi-joins."""

    def above(name: str, least: float) -> DataFrame:
        good = annotations.filter((F.col("name") == name) & (_value() > least)).select(F.col("id").alias("sample_annotation_id"))
        return elements.filter("element_type = 'image'").join(good, "sample_annotation_id", "left_semi").select("element_id")

    return above(*first).distinct().join(above(*second), "element_id", "left_semi")


def not_yet_annotated(sequences: DataFrame, annotations: DataFrame, name: str) -> DataFrame:
    """Sequences without an annotation of that name: what is left to do on resuming."""
    done = annotations.filter(F.col("name") == name).select(F.col("sequence_id").alias("id"))
    return sequences.select("id").join(done, "id", "left_anti")


def annotations_of_elements(annotations: DataFrame, elements: DataFrame, element_ids: list[str]) -> DataFrame:
    """The annotation of each listed element; of several the one with the greatest id, then name."""
    on = elements.filter(F.col("element_id").isin(element_ids)).select("element_id", F.col("sample_annotation_id").alias("id"))
    joined = on.join(annotations, "id").groupBy("element_id").agg(F.max(F.struct("id", "name", "value_json")).alias("a"))
    return joined.select("element_id", "a.id", "a.name", "a.value_json")


def zscore_outliers(annotations: DataFrame, name: str, threshold: float, k: int | None = None) -> DataFrame:
    """Annotations of ``name`` further than ``threshold`` standard deviations from the mean."""
    rows = annotations.filter(F.col("name") == name).select("id", "sequence_id", _value().alias("v")).filter("v is not null")
    stats = F.broadcast(rows.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")))
    z = (F.col("v") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    far = rows.crossJoin(stats).select("id", "sequence_id", F.round("v", 6).alias("value"), F.round(z, 6).alias("z")).filter(F.abs("z") > threshold)
    return far if k is None else far.orderBy(F.col("z").desc(), "id").limit(k)


def tag_counts(rows: DataFrame, tag: Column, missing: str = "未标注") -> DataFrame:
    """Counts and shares of one tag; null and '' count as ``missing``. Shares are of all rows."""
    label = F.coalesce(F.nullif(tag, F.lit("")), F.lit(missing))
    counts = rows.select(label.alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("tag", "n", F.round(100.0 * F.col("n") / total, 4).alias("pct"))


def multi_tag_counts(rows: DataFrame, tags: Column) -> DataFrame:
    """Counts of exploded tags; shares are of all tags."""
    counts = rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("tag", "n", F.round(100.0 * F.col("n") / total, 4).alias("pct"))


def cross_top(rows: DataFrame, group: str, tag: str, k: int) -> DataFrame:
    """The k most frequent tags of each group, ties by tag."""
    counts = rows.groupBy(group, tag).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), F.col(tag)))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)
