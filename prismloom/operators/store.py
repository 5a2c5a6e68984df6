"""The store's relational shape and its write path.

Views turn the exported tables into the normalised ones (sequences, images, texts and the
bridges between them). The write path flattens nested sequences into rows per table and
applies the store's three rules on who wins: within a batch the first row, across the
batches of one worker the last, and on merging into the store the row already there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import content_id
from .shred import latest_export

PRIMARY_KEYS = {
    "creators": ["id"],
    "annotations": ["id"],
    "images": ["id"],
    "texts": ["id"],
    "sequences": ["id"],
    "image_annotations": ["image_id", "annotation_id"],
    "text_annotations": ["text_id", "annotation_id"],
    "sequence_annotations": ["sequence_id", "annotation_id"],
    "sequence_images": ["sequence_id", "image_id", "index"],
    "sequence_texts": ["sequence_id", "text_id", "index"],
    "sample_annotations": ["id"],
    "sample_annotation_elements": ["sample_annotation_id", "element_id", "role"],
}


class StoreViews:
    """The store's tables over a folder of parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def images(self) -> DataFrame:
        return self._read("lance_images").select("id", "uri", "source", "width", "height")

    def blobs(self) -> DataFrame:
        return self._read("lance_images")

    def texts(self) -> DataFrame:
        return self._read("texts").select("id", "content", "uri", "source", "language")

    def creators(self) -> DataFrame:
        return self._read("creators").select("id", "name", "meta")

    def annotations(self) -> DataFrame:
        return self._read("annotations").select("id", "name", "type", "creator_id", "meta").distinct()

    def sample_annotations(self) -> DataFrame:
        return self._read("sample_annotations").select("id", "name", "creator_id", "sequence_id", "value_float", "value_json").distinct()

    def elements(self) -> DataFrame:
        return self._read("sample_annotation_elements").select("sample_annotation_id", "element_id", "element_type", "role").distinct()

    def exports(self) -> DataFrame:
        return latest_export(self._read("sequences_data"))

    def sequences(self) -> DataFrame:
        return self.exports().select(F.col("sequence_id").alias("id"), "uri", "source", "task_type")

    def _members(self, column: str, id_name: str) -> DataFrame:
        rows = self.exports().select("sequence_id", F.explode(column).alias("m")).filter("m.id is not null and m.index is not null")
        return rows.select("sequence_id", F.col("m.id").alias(id_name), F.col("m.index").alias("index")).distinct()

    def sequence_images(self) -> DataFrame:
        return self._members("images", "image_id")

    def sequence_texts(self) -> DataFrame:
        return self._members("texts", "text_id")


# -- who wins -----------------------------------------------------------------------
def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``. The filter on rank 1 is pruned within each
    map task, so a hot key reaches its reducer as one row per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def batch_dedup(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Within a batch the first row of a key wins."""
    return first_per_key(rows, keys, [F.col(order).asc()])


def upsert_replace(target: DataFrame, batches: DataFrame, keys: list[str], batch: str, order: str) -> DataFrame:
    """Replace: the last batch wins over earlier ones and over the target; inside a batch the first row."""
    staged = target.withColumn("__b", F.lit(None).cast("long")).withColumn("__o", F.lit(None).cast("long"))
    new = batches.withColumn("__b", F.col(batch).cast("long")).withColumn("__o", F.col(order).cast("long")).select(*staged.columns)
    return first_per_key(staged.unionByName(new), keys, [F.col("__b").desc_nulls_last(), F.col("__o").asc()]).drop("__b", "__o")


def merge_ignore(target: DataFrame, files: DataFrame, keys: list[str], file_no: str, order: str) -> DataFrame:
    """Merge: a row already in the target wins, then the earliest file, then the earliest row."""
    new = first_per_key(files, keys, [F.col(file_no).asc(), F.col(order).asc()]).select(*target.columns)
    return target.unionByName(new.join(target.select(*keys), keys, "left_anti"))


# -- flattening sequences -----------------------------------------------------------
ANNOTATION = "struct<name string, type string, meta string, creator_name string, creator_meta string>"
SEQUENCE = (
    "source string, uri string, meta string,"
    f" images array<struct<source:string, uri:string, bytes:binary, width:int, height:int, index:string, annotations:array<struct<name:string, meta:string, creator_name:string, creator_meta:string>>>>,"
    f" texts array<struct<source:string, uri:string, content:string, language:string, index:string, annotations:array<struct<name:string, meta:string, creator_name:string, creator_meta:string>>>>,"
    " annotations array<struct<name:string, meta:string, creator_name:string, creator_meta:string>>"
)


def index_name(position: Column) -> Column:
    """Position n becomes ``index_n``; a null position stays null."""
    return F.when(position.isNotNull(), F.concat(F.lit("index_"), position.cast("string")))


def flatten_sequences(sequences: DataFrame) -> dict[str, DataFrame]:
    """Rows of every table for nested sequences (schema SEQUENCE). Annotations of the
    sequence itself are kept in a bridge of their own; annotation meta is stored."""
    seq = sequences.withColumn("sequence_id", content_id(F.col("source"), F.col("uri")))
    img = seq.select("sequence_id", F.explode("images").alias("e")).withColumn("image_id", content_id(F.col("e.source"), F.col("e.uri"), F.md5("e.bytes")))
    txt = seq.select("sequence_id", F.explode("texts").alias("e")).withColumn("text_id", content_id(F.col("e.source"), F.col("e.uri"), F.col("e.content")))

    def labels(rows: DataFrame, owner: str, kind: str, column: str) -> DataFrame:
        a = rows.select(owner, F.explode(column).alias("a"))
        creator = content_id(F.col("a.creator_name"), F.col("a.creator_meta"))
        return a.select(owner, content_id(F.col("a.name"), F.lit(kind), F.col("a.meta")).alias("annotation_id"), F.col("a.name").alias("name"), F.lit(kind).alias("type"), F.when(F.col("a.creator_name").isNotNull(), creator).alias("creator_id"), "a.meta", "a.creator_name", "a.creator_meta")

    of_img, of_txt, of_seq = labels(img, "image_id", "image", "e.annotations"), labels(txt, "text_id", "text", "e.annotations"), labels(seq, "sequence_id", "sequence", "annotations")
    names = ["annotation_id", "name", "type", "creator_id", "meta", "creator_name", "creator_meta"]
    every = of_img.select(*names).unionByName(of_txt.select(*names)).unionByName(of_seq.select(*names))
    return {
        "sequences": seq.select(F.col("sequence_id").alias("id"), "uri", "source", "meta").dropDuplicates(["id"]),
        "images": img.select(F.col("image_id").alias("id"), "e.uri", "e.source", "e.width", "e.height").dropDuplicates(["id"]),
        "image_blobs": img.select(F.col("image_id").alias("id"), F.col("e.bytes").alias("image")).dropDuplicates(["id"]),
        "texts": txt.select(F.col("text_id").alias("id"), "e.content", "e.uri", "e.source", "e.language").dropDuplicates(["id"]),
        "sequence_images": img.select("sequence_id", "image_id", "e.index").distinct(),
        "sequence_texts": txt.select("sequence_id", "text_id", "e.index").distinct(),
        "creators": every.filter("creator_id is not null").select(F.col("creator_id").alias("id"), F.col("creator_name").alias("name"), F.col("creator_meta").alias("meta")).dropDuplicates(["id"]),
        "annotations": every.select(F.col("annotation_id").alias("id"), "name", "type", "creator_id", "meta").dropDuplicates(["id"]),
        "image_annotations": of_img.select("image_id", "annotation_id").distinct(),
        "text_annotations": of_txt.select("text_id", "annotation_id").distinct(),
        "sequence_annotations": of_seq.select("sequence_id", "annotation_id").distinct(),
    }


def bind_items(items: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Items with optional ``sequence_id``/``index``: all items, and the bridge of the bound ones."""
    own = f"{kind}_id"
    bridge = items.filter("sequence_id is not null and index is not null").select("sequence_id", F.col("id").alias(own), "index").distinct()
    return items.drop("sequence_id", "index").dropDuplicates(["id"]), bridge


def bind_annotations(annotations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels with an optional ``element_id``: all labels, the image bridge, the text bridge.
    Labels of another type are kept unbound."""
    of = lambda kind: annotations.filter((F.col("type") == kind) & F.col("element_id").isNotNull()).select(F.col("element_id").alias(f"{kind}_id"), F.col("id").alias("annotation_id")).distinct()
    return annotations.drop("element_id").dropDuplicates(["id"]), of("image"), of("text")


def split_value(value: Column) -> tuple[Column, Column]:
    """A JSON value: finite numbers and booleans go to value_float, all else (also what some parsers
    take for NaN or infinity) to value_json."""
    double = value.try_cast("double")
    double = F.when(~F.isnan(double) & (F.abs(double) < F.lit(float("inf"))), double)
    number = F.when(F.trim(value) == "true", 1.0).when(F.trim(value) == "false", 0.0).otherwise(double)
    return number.cast("float"), F.when(number.isNull(), value)


def sample_annotation_rows(rows: DataFrame) -> dict[str, DataFrame]:
    """``rows``: name, creator_name, creator_meta, sequence_id, value (JSON text), participants
    array<struct<element_id, element_type, role>>. The id is made of name, creator and
    participants, neither of the sequence nor of the value."""
    members = F.array_join(F.transform(F.coalesce("participants", F.array()), lambda p: F.concat_ws("\x1f", p["element_id"], p["element_type"], p["role"])), "\x1e")
    creator = content_id(F.col("creator_name"), F.col("creator_meta"))
    number, text = split_value(F.col("value"))
    made = rows.withColumn("creator_id", creator).withColumn("id", content_id(F.col("name"), F.col("creator_id"), members))
    return {
        "creators": made.select(F.col("creator_id").alias("id"), F.col("creator_name").alias("name"), F.col("creator_meta").alias("meta")).dropDuplicates(["id"]),
        "sample_annotations": made.select("id", "name", "creator_id", "sequence_id", number.alias("value_float"), text.alias("value_json")).dropDuplicates(["id"]),
        "sample_annotation_elements": made.select(F.col("id").alias("sample_annotation_id"), F.explode("participants").alias("p")).select("sample_annotation_id", "p.element_id", "p.role", "p.element_type").distinct(),
    }


def convert_ids(rows: DataFrame) -> DataFrame:
    """Every ``id`` and ``*_id`` column holding 16 bytes becomes canonical text, in nested
    structs and arrays too."""
    from ..functions.ids import dashed

    def fix(col: Column, dtype: T.DataType, name: str) -> Column:
        is_id = name == "id" or name.endswith("_id")
        if isinstance(dtype, T.BinaryType) and is_id:
            return F.when(F.octet_length(col) == 16, dashed(F.lower(F.hex(col))))
        if isinstance(dtype, T.StructType):
            return F.when(col.isNotNull(), F.struct(*[fix(col[f.name], f.dataType, f.name).alias(f.name) for f in dtype.fields]))
        if isinstance(dtype, T.ArrayType):
            return F.transform(col, lambda e: fix(e, dtype.elementType, name[:-1] if name.endswith("_ids") else name))
        return col

    return rows.select(*[fix(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in rows.schema.fields])
