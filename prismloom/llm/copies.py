"""Records that differ only in their formatting: canonical keys and an incremental ledger.

A record's canonical key is the md5 of its form without letter case, punctuation,
blanks and field order. The ledger holds per key the number of copies, the smallest id
and the earliest arrival, in buckets of the key. A batch is aggregated and becomes a run; runs of
one size class are full-outer joined bucket by bucket, counts added up and the earliest
representative kept, so no stored row is shuffled and each is written anew once a class: a
batch costs what it holds, and its share of merges that grow with the logarithm of the history.
The ledger is a folder with a manifest; ``CopyLedger(spark, path)`` opens it again in any session.

Results for odd input: a null content or record has no key and no copies; contents
without any letter or digit equal one another; text that looks like JSON but cannot be
parsed is plain text (a manifest: compared as it is). Ids are unique per table.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.buckets import BucketedTable
from ..plans.skew import join_by_weight
from ..plans.storage import Workspace, read_note, write_note

#: Full-width characters U+FF01..U+FF5E lie 0xFEE0 above their ordinary forms.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_TABLE = str.maketrans(_WIDE, _PLAIN)
MANIFEST_NUMBERS = ("width", "height", "file_size", "batch")
LEDGER = "key binary, n long, kept_id string, first_at timestamp_ntz"


def plain_form(text: Column) -> Column:
    """Letters and digits in order, without case."""
    return F.regexp_replace(F.lower(F.upper(F.translate(text, _WIDE, _PLAIN))), r"[^\p{L}\p{N}]", "")


def _plain(text: str) -> str:
    return "".join(c for c in text.translate(_TABLE).upper().lower() if c.isalnum())


def _canonical(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(sorted(f"{_plain(k)}:{_canonical(v)}" for k, v in value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    return _plain(value)


@F.pandas_udf(T.StringType())
def object_form(contents: pd.Series) -> pd.Series:
    """Canonical form of a JSON object, null for anything else."""

    def form(text: str | None) -> str | None:
        try:
            value = json.loads(text, parse_int=str, parse_float=str, parse_constant=str)
        except (TypeError, ValueError, RecursionError):
            return None
        return _canonical(value) if isinstance(value, dict) else None

    return contents.map(form)


def _key(kind: str, form: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(kind), form)))


def text_keys(texts: DataFrame) -> DataFrame:
    """(record_type, key, id, at). Of the contents only those that look like JSON objects go to Python."""
    rows = texts.filter("content is not null").select("id", "content", F.col("ingested_at").alias("at"))
    bare = F.regexp_replace(F.col("content"), r"^[\s\p{Z}﻿]+|[\s\p{Z}]+$", "")
    rows = rows.withColumn("form", object_form(F.when(bare.startswith("{"), bare)))
    key = F.when(F.col("form").isNotNull(), _key("J", F.col("form"))).otherwise(_key("P", plain_form(F.col("content"))))
    return rows.select(F.lit("text").alias("record_type"), key.alias("key"), "id", "at")


def manifest_keys(manifests: DataFrame) -> DataFrame:
    """(record_type, key, id, at) of image manifests."""
    fields = ["file_hash", "uri", *MANIFEST_NUMBERS, "color_mode"]
    parsed = manifests.filter("record is not null").select(F.col("manifest_id").alias("id"), F.col("received_at").alias("at"), "record", F.from_json("record", ", ".join(f"{f} string" for f in fields)).alias("r"))
    r = F.col("r")
    digits = F.regexp_replace(F.regexp_replace(F.lower(F.trim(r["file_hash"])), "^0x", ""), "[^0-9a-f]", "")
    parts = [digits, r["uri"], *[F.coalesce(r[n].try_cast("decimal(38,9)").cast("string"), r[n]) for n in MANIFEST_NUMBERS], F.lower(r["color_mode"])]
    form = F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("~")) for p in parts])
    is_object = r.isNotNull() & F.ltrim(F.col("record")).startswith("{") & F.coalesce(*parts).isNotNull()
    key = F.when(is_object, _key("M", form)).otherwise(_key("R", F.col("record")))
    return parsed.select(F.lit("manifest").alias("record_type"), key.alias("key"), "id", "at")


class CopyLedger:
    """Counts of canonical keys in ``path``; where the folder has a ledger already, it is opened. ``fan``
    runs of one size class (powers of ``fan`` rows) are merged; ``buckets`` is that of the session's shuffles."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fan: int = 4):
        self.spark, self.fan = spark, fan
        self.space = Workspace(spark, "ledger", path)
        self._note = f"{self.space.path}/manifest.json"
        self.state = read_note(spark, self._note) or {"buckets": buckets or self._shuffles(), "next": 1, "runs": {}}
        self.table = BucketedTable(spark, f"{self.space.path}/runs", LEDGER, "key", self.state["buckets"])

    def _shuffles(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def close(self) -> None:
        """Leave the catalog; the folder can be opened again."""
        self.table.close()

    def _add_run(self, rows: DataFrame, replaced: list[int]) -> None:
        gen = self.state["next"]
        self.state["next"] = gen + 1  # noted first: what a broken write leaves behind is never read
        write_note(self.spark, self._note, self.state)
        self.table.append(rows, gen)
        n = self.table.read([gen]).count()
        self.state["runs"] = {g: m for g, m in self.state["runs"].items() if int(g) not in replaced} | ({str(gen): n} if n else {})
        write_note(self.spark, self._note, self.state)
        self.table.discard(replaced)

    def read(self, runs: list[int] | None = None) -> DataFrame:
        """key, n, kept_id, first_at over the runs: joins bucket by bucket."""
        runs = [int(g) for g in self.state["runs"]] if runs is None else runs
        rows = self.table.read(runs[:1])
        for run in runs[1:]:
            rows = rows.alias("h").join(self.table.read([run]).alias("f"), "key", "full_outer")
            rows = rows.select("key", (F.coalesce("h.n", F.lit(0)) + F.coalesce("f.n", F.lit(0))).alias("n"), F.least("h.kept_id", "f.kept_id").alias("kept_id"), F.least("h.first_at", "f.first_at").alias("first_at"))
        return rows

    def add(self, batch: DataFrame) -> None:
        """``batch``: key, id, at. One shuffle of its counts; then merges that are due."""
        counted = batch.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("kept_id"), F.min(F.col("at").cast("timestamp_ntz")).alias("first_at"))
        # an aggregate leaves its rows in the buckets already where the ledger has as many as a shuffle
        self._add_run(counted if self._shuffles() == self.state["buckets"] else counted.repartition(self.state["buckets"], "key"), [])
        while True:
            classes: dict[int, list[int]] = {}
            for g, n in self.state["runs"].items():
                classes.setdefault(int(math.log(n, self.fan)), []).append(int(g))
            full = max(classes.values(), key=len, default=[])
            if len(full) < self.fan:
                return
            self._add_run(self.read(full), full)


def find_copies(spark: SparkSession, records: DataFrame, batch_of: Column, path: str | None = None) -> tuple[CopyLedger, DataFrame]:
    """Feed ``records`` (record_type, key, id, at) to a ledger batch by batch, then list every
    copy: record_type, kept_id, copy_id."""
    ledger = CopyLedger(spark, path)
    keyed = Workspace(spark, "copies").keep(records.withColumn("batch_no", F.coalesce(batch_of, F.lit(0)).cast("int")), "keys", ["batch_no"])
    sizes = {r.batch_no: r.n for r in keyed.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per batch
    for no in sorted(sizes):
        ledger.add(keyed.filter(F.col("batch_no") == no))
    several = ledger.read().filter("n > 1").select("key", "n", "kept_id")
    copies = join_by_weight(keyed.select("record_type", "key", "id"), several, "key", "n", max(1, sum(sizes.values())))
    return ledger, copies.filter("id <> kept_id").select("record_type", "kept_id", F.col("id").alias("copy_id"))
