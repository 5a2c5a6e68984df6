"""Export of training records from sequences and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHOICE = "array<struct<choice:array<struct<type:string,index:string,require_loss:boolean,ref_index:string>>>>"


def pick_source_target(images: Column) -> tuple[Column, Column]:
    """Ids of the last image whose index names a source ('prev', 'source') and of the last that names
    a target ('current', 'target'), in the order of the indexes."""
    ordered = F.array_sort(F.transform(F.filter(images, lambda e: e["index"].isNotNull() & e["id"].isNotNull()), lambda e: F.struct(e["index"].alias("index"), e["id"].alias("id"))))
    find = lambda a, b: F.try_element_at(F.filter(ordered, lambda e: e["index"].contains(a) | e["index"].contains(b)), F.lit(-1))["id"]
    return find("prev", "source"), find("current", "target")


def target_caption(*candidates: Column) -> Column:
    """First non-blank caption of the candidates: JSON with a caption field, or plain text."""
    read = [F.coalesce(F.get_json_object(c, "$.caption"), F.when(~F.ltrim(c).startswith("{"), c)) for c in candidates]
    return F.coalesce(*[F.nullif(F.trim(r), F.lit("")) for r in read])


def training_choices(sequences: DataFrame, roles: list[str]) -> DataFrame:
    """Sequences (sequence_id, images, texts) with a choice for each instruction role they have:
    source image, the role's texts, target image with loss. Members that no choice names are
    pruned; sequences without source, target or any role give no record."""
    members = lambda c: F.filter(F.coalesce(c, F.array()), lambda e: e.isNotNull() & e["index"].isNotNull())
    rows = sequences.withColumn("images", members(F.col("images"))).withColumn("texts", members(F.col("texts")))
    has = lambda column, index: F.exists(column, lambda e: e["index"] == index)
    named = F.filter(F.array(*[F.lit(r) for r in roles]), lambda r: F.exists("texts", lambda e: e["index"] == r))
    item = lambda kind, index, loss, ref: F.struct(F.lit(kind).alias("type"), index.alias("index"), F.lit(loss).alias("require_loss"), ref.cast("string").alias("ref_index"))
    none = F.lit(None)
    choice = F.transform(named, lambda r: F.struct(F.array(item("image", F.lit("source"), False, none), item("text", r, False, F.lit("source")), item("image", F.lit("target"), True, none)).alias("choice")))
    ready = rows.filter(has(F.col("images"), "source") & has(F.col("images"), "target")).withColumn("roles", named).filter("size(roles) > 0")
    return ready.select(
        "sequence_id",
        choice.alias("sequence_choices"),
        F.transform("roles", lambda r: F.lit(1.0)).alias("choices_weights"),
        F.filter("images", lambda e: e["index"].isin("source", "target")).alias("images"),
        F.filter("texts", lambda e: F.array_contains("roles", e["index"])).alias("texts"),
    )


def validate_records(records: DataFrame) -> DataFrame:
    """Per record: number of choices and items, and how many items name no member of their kind."""
    indexes = lambda c: F.transform(F.filter(F.coalesce(c, F.array()), lambda e: e.isNotNull()), lambda e: e["index"])
    items = F.flatten(F.transform(F.filter(F.coalesce("sequence_choices", F.array()), lambda c: c.isNotNull() & c["choice"].isNotNull()), lambda c: c["choice"]))
    rows = records.select("sequence_id", F.coalesce(F.size("sequence_choices"), F.lit(0)).alias("n_choices"), F.filter(items, lambda i: i.isNotNull()).alias("items"), indexes(F.col("images")).alias("in_images"), indexes(F.col("texts")).alias("in_texts"))
    known = lambda i: F.coalesce(F.when(i["type"] == "image", F.array_contains("in_images", i["index"])).when(i["type"] == "text", F.array_contains("in_texts", i["index"])), F.lit(False))
    return rows.select("sequence_id", F.greatest("n_choices", F.lit(0)).cast("int").alias("n_choices"), F.size("items").alias("n_items"), F.size(F.filter("items", lambda i: ~known(i))).alias("n_unknown"))
