"""Keyed files and tables in, reports and datasets out."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_extension, path_stem

PICTURES = ("png", "jpg", "jpeg", "webp", "bmp", "gif")
#: Quotes are doubled, line breaks and blanks kept; null is an empty field and '' a quoted one.
CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: On reading, an empty field without quotes takes this mark and so is told from ''.
CSV_READ = CSV | {"nullValue": "\0null\0"}


def keyed_images(spark: SparkSession, folder: str, with_data: bool = False) -> DataFrame:
    """(key, path[, data]) of the pictures in a folder; the key is the stem, of a stem's files the last path."""
    glob = "*.{" + ",".join([*PICTURES, *[p.upper() for p in PICTURES]]) + "}"
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    rows = rows.select(path_stem(F.col("path")).alias("key"), "path", *(["content"] if with_data else []))
    last = rows.groupBy("key").agg(F.max("path").alias("path"))
    return last if not with_data else rows.join(last, ["key", "path"], "left_semi").withColumnRenamed("content", "data")


def keyed_json(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, key, raw) of JSON files that hold one object of stem to value."""
    text = spark.read.text(path, wholetext=True).select(path_stem(F.input_file_name()).alias("dataset"), "value")
    return text.select("dataset", F.explode(F.from_json("value", "map<string,string>")).alias("key", "raw"))


def import_annotations(spark: SparkSession, path: str, fmt: str, value: str = "value", sequence: str = "sequence_id") -> tuple[DataFrame, DataFrame]:
    """Annotations of a CSV, Parquet or JSONL file and, apart, the rows that cannot be used (no
    sequence, no value or not readable)."""
    if fmt == "csv":
        rows = spark.read.options(**CSV_READ).csv(path)
    elif fmt == "parquet":
        rows = spark.read.parquet(path)
    elif fmt == "jsonl":
        rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    bad = F.col(sequence).isNull() | F.col(value).isNull()
    if "_corrupt" in rows.columns:
        rows = rows.cache()  # a query of the corrupt column alone is not allowed otherwise
        bad = bad | F.col("_corrupt").isNotNull()
    return rows.filter(~bad).drop("_corrupt"), rows.filter(bad)


def role_columns(rows: DataFrame, sequence: str = "sequence_id") -> list[tuple[str, str]]:
    """(column, role) of the element columns: every other ``*_id``."""
    return [(c, c.removesuffix("_id")) for c in rows.columns if c.endswith("_id") and c != sequence]


def discover_stores(root: str) -> list[str]:
    """Folders with a metadata file and an ``images`` folder; none is looked for below one."""
    found = []
    for folder, folders, files in os.walk(root):
        if "images" in folders and any(f.startswith("metadata") for f in files):
            found.append(folder)
            folders.clear()
    return sorted(found)


def store_config(path: str) -> dict:
    """Description of a store: [indexes] of "type:name" keys, tags and path patterns."""
    with open(path, "rb") as f:
        config = tomllib.load(f)
    indexes = [dict(zip(("type", "name"), k.split(":", 1), strict=True)) | {"description": v} for k, v in config.get("indexes", {}).items()]
    return config | {"indexes": indexes}


def is_valid_store(config: dict, tags: set[str], path: str) -> bool:
    return tags <= set(config.get("tags", [])) and all(p in path for p in config.get("path_contains", []))


# -- sinks --------------------------------------------------------------------------
def write_dataset(rows: DataFrame, path: str, mode: str = "append", sort: str | None = "id", per_file: int = 1 << 20) -> None:
    """Parquet in files of at most ``per_file`` rows, sorted within files so that min/max and bloom
    filters prune point reads. A failed job publishes nothing."""
    out = rows.sortWithinPartitions(sort) if sort and sort in rows.columns else rows
    writer = out.write.mode(mode).option("maxRecordsPerFile", per_file)
    if sort and sort in rows.columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{sort}", "true")
    writer.parquet(path)


def write_rows(rows: DataFrame, path: str, fmt: str) -> None:
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        writer.options(**CSV).csv(path)
    elif fmt == "jsonl":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def read_rows(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    """What ``write_rows`` wrote, in the types of ``schema``."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.options(**CSV_READ).csv(path)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown format {fmt}")


def write_report(rows: DataFrame, path: str) -> None:
    """A small report (one row per metric) as a single CSV file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def merge_shards(spark: SparkSession, paths: list[str], target: str, key: str = "id") -> None:
    """Several embedding datasets as one, replacing what is there."""
    write_dataset(spark.read.parquet(*paths).dropDuplicates([key]), target, "overwrite", key)


def staged_commit(spark: SparkSession, stagings: list[str], target: str, mode: str = "append") -> int:
    """Publish staged datasets together: all are read (a broken one raises and nothing is published),
    then appended or written over the target in one job. Stagings stay until the job is done."""
    parts = [spark.read.parquet(p) for p in stagings]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    n = rows.count()
    write_dataset(rows, target, mode)
    return n


__all__ = ["keyed_images", "keyed_json", "import_annotations", "role_columns", "discover_stores", "store_config", "is_valid_store", "write_dataset", "write_rows", "read_rows", "write_report", "merge_shards", "staged_commit", "path_extension"]
