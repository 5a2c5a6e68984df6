"""Tar archives as tables, and shards of them as output."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "url string, fname string, offset long, size long, data binary"
_HIDDEN = re.compile(r"__[^/]*__($|/)")
#: First bytes of a picture in hex, and its ending; anything else is taken for jpg.
MAGIC = (("89504E47", "png"), ("FFD8FF", "jpg"), ("47494638", "gif"), ("52494646", "webp"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"))


def _place(url: str):
    """File system and path of a URL, or of a plain local path. Any store that Arrow knows will do."""
    from pyarrow import fs

    if ":/" not in url:
        return fs.LocalFileSystem(), url
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", url))


def read_tar(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """Regular members of the archives under ``path`` (a file, a folder or a glob), hidden
    ``__x__`` members left out. Each archive is streamed by one task; its file listing is what
    is distributed, never its bytes through the driver."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar*").load(path).select("path")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url in batch["path"]:
                store, path = _place(url)
                found, size = [], 0
                with store.open_input_stream(path, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as archive:
                    for m in archive:
                        if not m.isreg() or ("/" not in m.name and m.name.startswith("__") and m.name.endswith("__")) or _HIDDEN.search(m.name):
                            continue
                        data = archive.extractfile(m).read() if with_data else None
                        found.append((url, m.name, m.offset_data, m.size, data))
                        size += m.size
                        if size > 32 << 20:
                            yield pd.DataFrame(found, columns=["url", "fname", "offset", "size", "data"])
                            found, size = [], 0
                if found:
                    yield pd.DataFrame(found, columns=["url", "fname", "offset", "size", "data"])

    return listing.repartition(F.col("path")).mapInPandas(members, MEMBERS)


def member_index(members: DataFrame) -> DataFrame:
    return members.select("url", "fname", "offset", "size")


def first_images(members: DataFrame, n: int) -> DataFrame:
    """The first n picture members of each archive by offset, with a name that is unique in it."""
    from pyspark.sql import Window

    pictures = members.filter(F.lower("fname").rlike(r"\.(png|jpe?g|webp|gif|bmp)$"))
    nth = F.row_number().over(Window.partitionBy("url").orderBy("offset"))
    chosen = pictures.withColumn("nth", nth).filter(F.col("nth") <= n)
    base = F.regexp_extract("fname", r"([^/]*)$", 1)
    again = F.row_number().over(Window.partitionBy("url", "base").orderBy("offset")) - 1
    stem, ext = F.regexp_replace("base", r"\.[^.]*$", ""), F.regexp_extract("base", r"(\.[^.]*)$", 1)
    named = chosen.withColumn("base", base).withColumn("again", again)
    return named.withColumn("out_name", F.when(F.col("again") == 0, F.col("base")).otherwise(F.concat(stem, F.format_string("_%03d", "again"), ext))).drop("base", "again")


def picture_ending(data):
    head = F.hex(F.substring(data, 1, 4))
    ending = None
    for magic, name in MAGIC:
        test = head.startswith(magic)
        ending = F.when(test, name) if ending is None else ending.when(test, name)
    return ending.otherwise("jpg")


def write_tar(rows: DataFrame, folder: str, per_shard: int = 1000) -> DataFrame:
    """``rows``: key, image binary, caption. Shards of about ``per_shard`` samples, each written by
    one task under its own name; rows without image are skipped. Returns shard and its samples."""
    n = rows.count()
    shards = max(1, -(-n // per_shard))
    placed = rows.filter("image is not null").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).withColumn("ext", picture_ending(F.col("image")))

    def write(group: pd.DataFrame) -> pd.DataFrame:
        import uuid

        shard = int(group["shard"].iloc[0])
        name = f"{folder}/shard-{shard:06d}.tar"
        store, path = _place(name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        # written aside and renamed, so that a task that runs twice leaves one whole shard
        draft = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as stream, tarfile.open(fileobj=stream, mode="w|") as archive:
            for r in group.sort_values("key").itertuples():
                for ending, data in ((r.ext, r.image), ("txt", (r.caption or "").encode())):
                    info = tarfile.TarInfo(f"{r.key}.{ending}")
                    info.size = len(data)
                    archive.addfile(info, io.BytesIO(data))
        store.move(draft, path)
        return pd.DataFrame({"shard": [name], "n": [len(group)]})

    return placed.select("shard", "key", "image", "caption", "ext").groupBy("shard").applyInPandas(write, "shard string, n long")
