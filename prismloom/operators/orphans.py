"""References to records that do not exist, and what hangs below them.

References are edges of a foreign-key graph. *Direct* orphans name a target that
is deleted, missing or arrived only later; records whose own reference target is
itself an orphan are *inherited* orphans, found by iterating semi-joins down the
graph until no new record is reached.

Results for odd input: a null target is no reference; an unknown element type has
no target table and is not reported; an id that does not hold 32 hex digits is
missing and is given as trimmed lower-case text; repeated references count once,
at their earliest time; a reference without time is never late and has a null
period. Empty tables give empty results; extra columns are ignored.

Scale: references and targets are each reduced with partial aggregation before they
meet; keys travel as 16 bytes. A target named by a third of all references is one
row on its side, and AQE splits the other side of that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import id_key, key_text
from ..plans.storage import Workspace

#: element_type -> target table
ELEMENT_TARGETS = {"image": "lance_images", "text": "texts", "sample_annotation": "sample_annotations"}
#: target table -> column holding the arrival
ARRIVALS = {"lance_images": "ingested_at", "texts": "ingested_at", "sample_annotations": "created_at", "creators": "created_at"}
TABLES = list(ARRIVALS)


def _sources() -> Column:
    """Names of the referring tables by their number."""
    return F.array(F.lit("sample_annotation_elements"), F.lit("annotations"))


def _code(table: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for i, t in enumerate(TABLES) for x in (t, i)])
    return lookup[table].cast("tinyint")


def references(elements: DataFrame, annotations: DataFrame) -> DataFrame:
    """(src, ref, role, tab, key, at): every reference once, at its earliest time."""
    targets = F.create_map(*[F.lit(x) for k, t in ELEMENT_TARGETS.items() for x in (k, TABLES.index(t))])
    of_elements = elements.select(
        F.lit(0).cast("tinyint").alias("src"),
        id_key(F.col("sample_annotation_id")).alias("ref"),
        "role",
        targets[F.lower(F.trim(F.col("element_type")))].cast("tinyint").alias("tab"),
        id_key(F.col("element_id")).alias("key"),
        F.col("created_at").alias("at"),
    )
    of_labels = annotations.select(
        F.lit(1).cast("tinyint").alias("src"),
        id_key(F.col("id")).alias("ref"),
        F.lit("creator").alias("role"),
        F.lit(TABLES.index("creators")).cast("tinyint").alias("tab"),
        id_key(F.col("creator_id")).alias("key"),
        F.col("created_at").alias("at"),
    )
    every = of_elements.unionByName(of_labels).filter("key is not null and tab is not null")
    return every.groupBy("src", "ref", "role", "tab", "key").agg(F.min("at").alias("at"))


def target_states(tables: dict[str, DataFrame], deleted: DataFrame) -> DataFrame:
    """(tab, key, present, first_at, gone): one row per known or deleted target."""
    parts = [
        rows.select(F.lit(TABLES.index(name)).cast("tinyint").alias("tab"), id_key(F.col("id")).alias("key"), F.lit(True).alias("here"), F.col(ARRIVALS[name]).alias("at"), F.lit(None).cast("timestamp_ntz").alias("del_at"), F.lit(False).alias("named"))
        for name, rows in tables.items()
    ]
    parts.append(
        deleted.select(_code(F.trim(F.lower(F.col("entity_table")))).alias("tab"), id_key(F.col("entity_id")).alias("key"), F.lit(False).alias("here"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("deleted_at").alias("del_at"), F.lit(True).alias("named"))
    )
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    seen = every.filter("tab is not null and key is not null").groupBy("tab", "key").agg(F.max("here").alias("present"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("del_at").alias("del_at"), F.max("named").alias("named"))
    gone = F.col("named") & ~F.coalesce(F.col("last_at") > F.col("del_at"), F.lit(False))
    return seen.select("tab", "key", "present", "first_at", gone.alias("gone"))


def direct_orphans(refs: DataFrame, states: DataFrame) -> DataFrame:
    """References with a status, joined once by target."""
    status = F.when(F.col("gone"), "deleted").when(~F.coalesce(F.col("present"), F.lit(False)), "missing").when(F.col("first_at") > F.col("at"), "late")
    return refs.join(states, ["tab", "key"], "left").withColumn("status", status).filter("status is not null").select("src", "ref", "role", "tab", "key", "at", "status")


def render(orphans: DataFrame) -> DataFrame:
    return orphans.select(
        _sources()[F.col("src").cast("int")].alias("ref_table"),
        key_text(F.col("ref")).alias("ref_id"),
        "role",
        key_text(F.col("key")).alias("target_id"),
        F.date_format("at", "yyyy-MM").alias("period"),
        "status",
    )


def cascade(spark: SparkSession, tables: dict[str, DataFrame], unsound: tuple[str, ...] = ("deleted", "missing")) -> DataFrame:
    """Every unsound reference and all that hang below: src, ref, role, tab, key, at, status, depth.
    Depth 0 are the direct orphans with their status ('deleted', 'missing', 'late'); below those of
    ``unsound`` hang the 'inherited' ones, found layer by layer until none is new. A late target
    exists by now, so by default it orphans nothing; a late reference that also hangs below an
    orphan is in both. Cycles end, as a record is reached once."""
    space = Workspace(spark, "orphans")
    refs = references(tables["sample_annotation_elements"], tables["annotations"])
    states = target_states({t: tables[t] for t in TABLES}, tables["deleted_ids"])
    direct = space.keep(direct_orphans(refs, states), "direct")
    seeds = direct.filter(F.col("status").isin(*unsound))
    # the edges a layer can go down: references to sample annotations that are no seeds themselves
    edge = ["src", "ref", "role", "tab", "key"]
    below = references(tables["sample_annotation_elements"].filter(F.lower(F.trim(F.col("element_type"))) == "sample_annotation"), tables["annotations"].limit(0))
    down = space.keep(below.join(seeds.filter(F.col("tab") == TABLES.index("sample_annotations")), edge, "left_anti"), "down")
    frontier = seeds.filter("src = 0").select(F.col("ref").alias("key")).distinct()
    found, reached, depth = direct.withColumn("depth", F.lit(0)), frontier, 0
    while True:
        depth += 1
        layer = space.keep(down.join(frontier, "key", "left_semi").select(*edge, "at", F.lit("inherited").alias("status"), F.lit(depth).alias("depth")), "layer")
        # an edge is met once, as its key is in one frontier only
        frontier = space.keep(layer.select(F.col("ref").alias("key")).distinct().join(reached, "key", "left_anti"), "frontier")
        found = found.unionByName(layer)
        if frontier.isEmpty():
            return found
        reached = reached.unionByName(frontier)


def find_orphans(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Every unsound reference, the first layer of the cascade: ref_table, ref_id, role, target_id, period, status."""
    return render(cascade(spark, tables).filter("depth = 0"))


def orphan_report(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Unsound references per table, month, origin ('direct' or 'inherited') and status."""
    found = cascade(spark, tables)
    origin = F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("origin")
    shown = found.select(_sources()[F.col("src").cast("int")].alias("ref_table"), F.date_format("at", "yyyy-MM").alias("period"), origin, "status")
    return shown.groupBy("ref_table", "period", "origin", "status").agg(F.count(F.lit(1)).alias("n"))
