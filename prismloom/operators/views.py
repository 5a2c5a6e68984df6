"""Reads across sequences, images, texts and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequence_view(sequences: DataFrame, sequence_images: DataFrame, sequence_texts: DataFrame, images: DataFrame, texts: DataFrame) -> DataFrame:
    """One nested row per sequence. Each bridge is joined and collected on its own, so images
    and texts never fan out; a side without members is null, arrays are sorted."""
    imgs = sequence_images.join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id").groupBy("sequence_id").agg(F.array_sort(F.collect_set(F.struct("index", F.col("image_id").alias("id"), "width", "height"))).alias("images"))
    txts = sequence_texts.join(texts.select(F.col("id").alias("text_id"), "language", "content"), "text_id").groupBy("sequence_id").agg(F.array_sort(F.collect_set(F.struct("index", F.col("text_id").alias("id"), "language", "content"))).alias("texts"))
    seq = sequences.withColumnRenamed("id", "sequence_id")
    return seq.join(imgs, "sequence_id", "left").join(txts, "sequence_id", "left")


def by_values(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is one of ``values``; a long list becomes a semi-join."""
    if len(values) <= 200:
        return rows.filter(F.col(column).isin(values))
    wanted = rows.sparkSession.createDataFrame([(v,) for v in set(values)], [column])
    return rows.join(wanted, column, "left_semi")


def images_of_sources(sequences: DataFrame, sequence_images: DataFrame, images: DataFrame, sources: list[str]) -> DataFrame:
    wanted = by_values(sequences, "source", sources).select(F.col("id").alias("sequence_id"))
    return sequence_images.join(wanted, "sequence_id").join(images.select(F.col("id").alias("image_id"), "uri"), "image_id").select("sequence_id", "image_id", "uri").distinct()


def image_text_pairs(sequence_images: DataFrame, sequence_texts: DataFrame, text_role_like: str) -> DataFrame:
    """Image and text of one sequence, texts by role."""
    texts = sequence_texts.filter(F.col("index").like(text_role_like)).select("sequence_id", "text_id", F.col("index").alias("text_role"))
    return sequence_images.select("sequence_id", "image_id", F.col("index").alias("image_role")).join(texts, "sequence_id")


def role_triples(sequence_images: DataFrame, sequence_texts: DataFrame, source: str, target: str, text_like: str) -> DataFrame:
    """(source image, target image, text) by role within a sequence. Roles are filtered before the joins."""
    a = sequence_images.filter(F.col("index") == source).select("sequence_id", F.col("image_id").alias("source_image"))
    b = sequence_images.filter(F.col("index") == target).select("sequence_id", F.col("image_id").alias("target_image"))
    t = sequence_texts.filter(F.col("index").like(text_like)).select("sequence_id", "text_id")
    return a.join(b, "sequence_id").join(t, "sequence_id")


def bilingual(sequence_texts: DataFrame, texts: DataFrame, cn: str, en: str) -> DataFrame:
    """Chinese and English text of one sequence."""
    body = texts.select(F.col("id").alias("text_id"), "content")
    one = lambda role, name: sequence_texts.filter(F.col("index") == role).join(body, "text_id").select("sequence_id", F.col("content").alias(name))
    return one(cn, "caption_cn").join(one(en, "caption_en"), "sequence_id").distinct()


def caption_for_language(stem, caption_cn, caption_en):
    """The caption whose language the file stem names."""
    return F.when(stem.contains("cn"), caption_cn).otherwise(caption_en)


def labelled_sequences(sequence_images: DataFrame, elements: DataFrame, minimum: int) -> DataFrame:
    """Sequences with at least ``minimum`` distinct annotated images."""
    marked = elements.filter("element_type = 'image'").select(F.col("element_id").alias("image_id")).distinct()
    hits = sequence_images.join(marked, "image_id", "left_semi").groupBy("sequence_id").agg(F.count_distinct("image_id").alias("n_images"))
    return hits.filter(F.col("n_images") >= minimum)


def labels_with_creator(annotations: DataFrame, creators: DataFrame) -> DataFrame:
    names = creators.select(F.col("id").alias("creator_id"), F.col("name").alias("creator_name"))
    return annotations.join(names, "creator_id", "left").select("id", "name", "type", "creator_name")


def first_source_match(keys: DataFrame, *lookups: DataFrame) -> DataFrame:
    """``keys``: key. Each lookup: key, value. The value of the first lookup that has the key."""
    found = keys
    for i, rows in enumerate(lookups):
        found = found.join(rows.groupBy("key").agg(F.min("value").alias(f"v{i}")), "key", "left")
    return found.select("key", F.coalesce(*[F.col(f"v{i}") for i in range(len(lookups))]).alias("value"))


def sequences_of_images(sequence_images: DataFrame) -> DataFrame:
    return sequence_images.groupBy("image_id").agg(F.array_sort(F.collect_set("sequence_id")).alias("sequences"))


def gallery_pairs(sequences: DataFrame, members: DataFrame, by_uri: DataFrame) -> DataFrame:
    """Members named by uri resolved to ids, and bound to their sequence: sequence_id, image_id, index."""
    ids = uri_ids(by_uri)
    return sequences.join(members, "sequence_id").join(ids, "uri").select("sequence_id", F.col("id").alias("image_id"), "index").distinct()


def uri_ids(rows: DataFrame, source: str | None = None) -> DataFrame:
    """uri -> id; of several ids the greatest."""
    chosen = rows if source is None else rows.filter(F.col("source") == source)
    return chosen.filter("uri is not null").groupBy("uri").agg(F.max("id").alias("id"))
