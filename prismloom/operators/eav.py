"""Attribute-value rows into wide tables, as log-structured upserts.

A batch of (entity, attribute, value) rows becomes a *run*: sparse wide rows, one per
entity, in buckets of the entity and sorted by it, in which each filled cell carries its
version (time, annotation id). A batch never rewrites what is stored. Runs of one size
class are compacted into one, bucket by bucket: a full outer join of runs that are
bucketed alike moves no row, and of each cell the latest version stays, so a late old
value loses to a newer one whichever came first. Reading merges what runs are left.

The table is a folder with a manifest that names the committed runs; any session opens it.

Results for odd input: a null entity, an unknown attribute or an unreadable
value gives no cell; repeated rows give one cell; a null time counts as the
earliest; equal versions are told apart by the greater value; an empty batch
gives an empty run. A whole number beyond 64 bits is a readable integer (its cell is
filled) but has a null value. Columns other than the six named ones are ignored.

Scale: cells are reduced per (entity, attribute) with partial aggregation before the first
shuffle, so an entity holding a third of all rows reaches the reducers as at most one row
per attribute and map task, and its bucket as one row per attribute.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import id_key, key_text
from ..plans.buckets import BucketedTable
from ..plans.storage import Workspace, read_note, write_note

TYPES = {"float": "double", "integer": "bigint", "boolean": "boolean", "string": "string"}
EARLIEST = -(2**63)
CELL = "struct<ver:bigint,id:binary,num:double,whole:bigint,txt:string>"
#: A number as JSON or plain text spells it.
SPELLED_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
JSON_NUMBER = r"^\s*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$"


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str

    @property
    def key(self) -> str:
        return "".join(c for c in self.name.lower() if c.isalnum())


def attribute_key(col: Column) -> Column:
    """Name without letter case and without anything but letters and digits."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]", "")


def attributes_of(types: DataFrame) -> list[Attribute]:
    """The wide table's columns. The list defines a schema, so it is small by nature;
    two names with one key are an error."""
    found = [Attribute(r.name, r.value_type) for r in types.select("name", "value_type").distinct().orderBy("name").collect() if r.name and r.value_type in TYPES]
    if len({a.key for a in found}) < len(found):
        raise ValueError("two attributes share a name apart from case and signs")
    return found


def _finite(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)


def readable_number(value_float: Column, value_json: Column) -> Column:
    """The number a row gives, else null (see the rules in TESTDATA.md, problem 1)."""
    value = F.trim(value_json)
    text = F.get_json_object(value_json, "$")
    variant = F.try_parse_json(value_json)
    score = F.try_variant_get(variant, "$.score", "variant")
    kind = F.schema_of_variant(score)
    from_json = (
        F.when(value_json.rlike(JSON_NUMBER), value.try_cast("double"))
        .when(value.startswith('"'), F.when(text.rlike(SPELLED_NUMBER), F.trim(text).try_cast("double")))
        .when(value.startswith("{"), F.when(kind.rlike("^(BIGINT|TINYINT|SMALLINT|INT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(variant, "$.score", "double")))
    )
    return _finite(F.when(value_float.isNotNull(), value_float.cast("double")).otherwise(from_json))


def readable_boolean(value_float: Column, value_json: Column) -> Column:
    value = F.trim(value_json)
    word = F.lower(F.when(value.startswith('"'), F.get_json_object(value_json, "$")).when(value.isin("true", "false"), value))
    truth = F.when(word.isin("true", "yes"), 1.0).when(word.isin("false", "no"), 0.0)
    number = value_float.cast("double")
    return F.when(value_float.isNotNull(), F.when(number.isin(0.0, 1.0), number)).otherwise(truth)


def readable_string(value_float: Column, value_json: Column) -> Column:
    text = F.when(F.trim(value_json).startswith('"'), F.get_json_object(value_json, "$"))
    return F.when(value_float.isNull() & text.rlike(r"[^\s\p{Z}]"), text)


def read_cells(rows: DataFrame, attributes: list[Attribute], gen: Column) -> DataFrame:
    """(gen, entity, attr, cell): the readable cells of a batch, integers with all their digits."""
    spark = rows.sparkSession
    known = F.broadcast(spark.createDataFrame([(a.key, i, a.kind) for i, a in enumerate(attributes)], "akey string, attr int, kind string"))  # the schema's columns
    named = rows.filter("sequence_id is not null and name is not null").withColumn("akey", attribute_key(F.col("name"))).join(known, "akey")
    vf, vj, kind = F.col("value_float"), F.col("value_json"), F.col("kind")
    # the number is a column of its own, so that it is worked out once per row
    read = named.select(
        gen.alias("gen"),
        id_key(F.col("sequence_id")).alias("entity"),
        "attr",
        F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(EARLIEST)).alias("ver"),
        id_key(F.col("id")).alias("id"),
        "kind",
        F.when(kind.isin("float", "integer"), readable_number(vf, vj)).when(kind == "boolean", readable_boolean(vf, vj)).alias("num"),
        F.when((kind == "integer") & vf.isNull() & vj.rlike(r"^\s*-?[0-9]+\s*$"), F.trim(vj).try_cast("bigint")).alias("digits"),
        F.when(kind == "string", readable_string(vf, vj)).alias("txt"),
    )
    number = F.when((kind != "integer") | (F.col("num") % 1 == 0), F.col("num"))
    whole = F.when(kind == "integer", F.coalesce(F.col("digits"), number.try_cast("bigint")))
    cells = read.select("gen", "entity", "attr", "ver", "id", number.alias("num"), whole.alias("whole"), "txt").filter("num is not null or txt is not null")
    return cells.select("gen", "entity", "attr", F.struct("ver", "id", "num", "whole", "txt").alias("cell"))


class WideTable:
    """A wide table stored as sorted runs in ``path``; where the folder has one already, it is opened.
    ``fan`` runs of one size class (powers of ``fan`` rows) are compacted together."""

    def __init__(self, spark: SparkSession, attributes: list[Attribute], path: str | None = None, fan: int = 4):
        self.spark, self.attributes, self.fan = spark, attributes, fan
        self.space = Workspace(spark, "wide", path)
        self._note = f"{self.space.path}/manifest.json"
        self.state = read_note(spark, self._note) or {"attributes": [[a.name, a.kind] for a in attributes], "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "next": 1, "runs": {}}
        if self.state["attributes"] != [[a.name, a.kind] for a in attributes]:
            raise ValueError(f"the table in {self.space.path} has other attributes")
        schema = ", ".join(["entity binary", *[f"{c} {CELL}" for c in self._columns()]])
        self.table = BucketedTable(spark, f"{self.space.path}/runs", schema, "entity", self.state["buckets"], ordered=True)

    @property
    def runs(self) -> list[int]:
        return [int(g) for g in self.state["runs"]]

    def close(self) -> None:
        """Leave the catalog; the folder can be opened again."""
        self.table.close()

    def _columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.attributes))]

    def upsert(self, batch: DataFrame, part: Column | None = None, parts: int = 1) -> None:
        """Convert a batch into a run. ``part`` (0 to ``parts`` - 1) may split a bulk load into several
        batches, which become runs of their own in one job."""
        first = self.state["next"]
        self.state["next"] = first + parts  # noted first: what a broken write leaves behind is never read
        write_note(self.spark, self._note, self.state)
        gen = (F.lit(first) + (F.lit(0) if part is None else part)).cast("long")
        tagged = batch.select("id", "name", "sequence_id", "value_float", "value_json", "created_at")
        cells = read_cells(tagged, self.attributes, gen)
        # one row per cell, combined before it is shuffled; these few go to their entity's bucket and are laid side by side there
        latest = cells.groupBy("gen", "entity", "attr").agg(F.max("cell").alias("cell")).repartition(self.table.buckets, "entity")
        rows = latest.groupBy("gen", "entity").agg(F.map_from_entries(F.collect_list(F.struct("attr", "cell"))).alias("m"))
        self.table.append(rows.select("gen", "entity", *[F.try_element_at("m", F.lit(i)).alias(c) for i, c in enumerate(self._columns())]))
        sizes = self.table.read(list(range(first, first + parts)), keep_gen=True).groupBy("gen").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per run
        self.state["runs"] |= {str(r.gen): r.n for r in sorted(sizes, key=lambda r: r.gen)}
        write_note(self.spark, self._note, self.state)

    def merged(self, runs: list[int] | None = None) -> DataFrame:
        """Latest version of each cell over the runs: joins bucket by bucket."""
        runs = self.runs if runs is None else runs
        rows = self.table.read(runs[:1])
        for run in runs[1:]:
            other = self.table.read([run]).select("entity", *[F.col(c).alias(f"o_{c}") for c in self._columns()])
            rows = rows.join(other, "entity", "full_outer").select("entity", *[F.greatest(c, f"o_{c}").alias(c) for c in self._columns()])
        return rows

    def compact(self, whole: bool = False) -> None:
        """Compact each size class that has ``fan`` runs, or all runs into one."""
        while True:
            classes: dict[int, list[int]] = {}
            for g, n in self.state["runs"].items():
                classes.setdefault(0 if whole else int(math.log(max(n, 1), self.fan)), []).append(int(g))
            full = max(classes.values(), key=len, default=[])
            if len(full) < (2 if whole else self.fan):
                return
            gen = self.state["next"]
            self.state["next"] = gen + 1
            write_note(self.spark, self._note, self.state)
            self.table.append(self.merged(full), gen)
            n = self.table.read([gen]).count()
            self.state["runs"] = {g: m for g, m in self.state["runs"].items() if int(g) not in full} | {str(gen): n}
            write_note(self.spark, self._note, self.state)
            self.table.discard(full)

    def read(self) -> DataFrame:
        """One row per entity, one typed column per attribute."""

        def typed(i: int, a: Attribute) -> Column:
            cell = F.col(f"c{i}")
            value = cell["txt"] if a.kind == "string" else cell["whole"] if a.kind == "integer" else cell["num"].cast(TYPES[a.kind])
            return value.alias(a.name)

        return self.merged().select(key_text(F.col("entity")).alias("sequence_id"), *[typed(i, a) for i, a in enumerate(self.attributes)])

    def cell_sources(self) -> DataFrame:
        """(sequence_id, name, annotation_id) of every filled cell."""
        entries = F.array(*[F.struct(F.lit(a.name).alias("name"), F.col(f"c{i}")["id"].alias("id"), F.col(f"c{i}").isNotNull().alias("filled")) for i, a in enumerate(self.attributes)])
        cells = self.merged().select("entity", F.explode(F.filter(entries, lambda e: e["filled"])).alias("e"))
        return cells.select(key_text(F.col("entity")).alias("sequence_id"), F.col("e.name").alias("name"), key_text(F.col("e.id")).alias("annotation_id"))


def load_wide(spark: SparkSession, annotations: DataFrame, types: DataFrame, path: str | None = None, batches: int = 4) -> WideTable:
    """Bulk load as ``batches`` upserts in no order of time, so that old and new versions of a cell
    lie in different runs, and their compaction."""
    table = WideTable(spark, attributes_of(types), path)
    table.upsert(annotations, F.pmod(F.xxhash64("id"), F.lit(batches)), batches)
    table.compact()
    return table
