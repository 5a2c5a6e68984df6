"""Deeply nested records into related flat tables by shared inlining.

The schema graph decides the tables: a struct that occurs once below its parent is
inlined into the parent's row; every array or map element gets a table of its own;
an element type reached from several parents under one signature is *shared* (one
table, each row naming its parent table); a struct nested in itself under the same
field name is *recursive* (one table whose rows point to rows of the same table).

Every child row carries the key columns of the root record, ``parent_table``,
``parent_path`` (positions from the root, '' for a root row) and its own ``path``,
so (keys, parent_path) is the foreign key and (keys, path) the primary key.
Positions count from 1 and count null neighbours.

Results for odd input: null and empty arrays give no rows; a null element gives a
row whose ``is_null`` is true, so positions stay whole; clashing column names get
the inlined path as prefix. Flattening is a chain of generators without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import Workspace

LINKS = ("parent_table", "parent_path", "path", "is_null")


@dataclass
class Node:
    """An element that has a table: where it hangs and what is inlined into it."""

    name: str
    parent: str | None
    access: tuple[str, ...]
    element: T.DataType
    is_map: bool = False
    scalars: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    children: list["Node"] = field(default_factory=list)


def _signature(dtype: T.DataType) -> str:
    return dtype.simpleString()


def analyse(schema: T.StructType, root: str, keys: list[str]) -> Node:
    """Walk the schema graph and decide for every element: inline or table."""

    def walk(node: Node, struct: T.StructType, access: tuple[str, ...]) -> None:
        for f in struct.fields:
            if not access and node.parent is None and f.name in keys:
                continue
            here = (*access, f.name)
            if isinstance(f.dataType, T.StructType):
                walk(node, f.dataType, here)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                is_map = isinstance(f.dataType, T.MapType)
                element = f.dataType.valueType if is_map else f.dataType.elementType
                child = Node("_".join((node.name, *here)), node.name, here, element, is_map)
                grow(child)
                node.children.append(child)
            else:
                node.scalars.append(("_".join(here), here))

    def grow(node: Node) -> None:
        if isinstance(node.element, T.StructType):
            walk(node, node.element, ())
        elif isinstance(node.element, (T.ArrayType, T.MapType)):
            is_map = isinstance(node.element, T.MapType)
            inner = node.element.valueType if is_map else node.element.elementType
            child = Node(f"{node.name}_item", node.name, (), inner, is_map)
            grow(child)
            node.children.append(child)
        else:
            node.scalars.append(("value", ()))

    top = Node(root, None, (), schema)
    walk(top, schema, ())
    return top


def _get(base: Column | None, access: tuple[str, ...]) -> Column:
    if base is None:
        base, access = F.col(f"`{access[0]}`"), access[1:]
    for name in access:
        base = base[name]
    return base


def shred(df: DataFrame, keys: list[str], root: str = "root", share: bool = True) -> dict[str, DataFrame]:
    """Tables by name. ``keys`` identify a root record and come first in every table."""
    top = analyse(df.schema, root, keys)
    key_cols = [F.col(f"`{k}`") for k in keys]
    pieces: dict[str, list[DataFrame]] = {}
    signatures: dict[str, str] = {}
    shared: dict[str, list[str]] = {}

    def scan(node: Node) -> None:
        if node.parent is not None and isinstance(node.element, T.StructType):
            sig = f"{node.access[-1] if node.access else ''}|{_signature(node.element)}"
            shared.setdefault(sig, []).append(node.name)
        for child in node.children:
            scan(child)

    scan(top)
    if share:
        for names in shared.values():
            if len(names) > 1:
                for n in names:
                    signatures[n] = names[0]
    recursive: dict[str, str] = {}

    def mark(node: Node, above: list[Node]) -> None:
        for a in above:
            if a.parent is not None and node.access and a.access and node.access[-1] == a.access[-1] and isinstance(node.element, T.StructType) and isinstance(a.element, T.StructType) and set(node.element.names) <= set(a.element.names):
                recursive[node.name] = recursive.get(a.name, a.name)
                break
        for child in node.children:
            mark(child, [*above, node])

    mark(top, [])
    table_of = lambda n: recursive.get(n, signatures.get(n, n))

    pieces[root] = [df.select(*key_cols, *[_get(None, a).alias(n) for n, a in top.scalars])]

    def emit(node: Node, source: DataFrame, base: Column | None, parent_path: Column, parent: str) -> None:
        """``source`` has the keys, the parent's element and its path."""
        array = _get(base, node.access) if node.access or base is not None else base
        if node.is_map:
            array = F.transform(F.map_entries(array), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        rows = source.select(*key_cols, parent_path.alias("__pp"), F.posexplode(array).alias("__p", "__e"))
        own = F.concat(F.when(F.col("__pp") == "", F.lit("")).otherwise(F.concat(F.col("__pp"), F.lit("."))), (F.col("__p") + 1).cast("string"))
        rows = rows.select(*key_cols, "__pp", own.alias("__path"), F.col("__e"))
        value = F.col("__e")["value"] if node.is_map else F.col("__e")
        columns = [F.lit(parent).alias("parent_table"), F.col("__pp").alias("parent_path"), F.col("__path").alias("path"), value.isNull().alias("is_null")]
        if node.is_map:
            columns.append(F.col("__e")["key"].cast("string").alias("map_key"))
        taken = {*keys, *LINKS}
        columns += [_get(value, a).alias(n if n not in taken else f"{node.access[-1] if node.access else 'item'}_{n}") for n, a in node.scalars]
        pieces.setdefault(table_of(node.name), []).append(rows.select(*key_cols, *columns))
        for child in node.children:
            emit(child, rows, value, F.col("__path"), table_of(node.name))

    for child in top.children:
        emit(child, df, None, F.lit(""), root)
    result = {}
    for name, parts in pieces.items():
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part, allowMissingColumns=True)
        result[name] = table
    return result


def latest_export(rows: DataFrame, key: str = "sequence_id", version: str = "create_time") -> DataFrame:
    """Of several rows of a key the one with the latest version (null is earliest; among
    equals the one with the greatest content hash). The filter on rank 1 lets Spark
    prune within each map task first, so a hot key never reaches one reducer whole."""
    payload = F.xxhash64(*[F.map_entries(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in rows.schema.fields])
    order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.col("__h").desc())
    return rows.withColumn("__h", payload).withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__h")


def shred_latest(spark: SparkSession, rows: DataFrame, key: str, root: str) -> dict[str, DataFrame]:
    """The tables of the latest exports. These are decided once and written between, in the key's
    order, so that each table reads its own columns of what is left and none sorts the exports again."""
    held = Workspace(spark, "shred").keep(latest_export(rows, key), "latest")
    return shred(held, [key], root)


def resolve_members(tables: dict[str, DataFrame], root: str = "seq") -> DataFrame:
    """Each non-null choice item with the members of its sequence that carry its index:
    sequence_id, choice_no, item_no, element_id ('' where none matches)."""
    items = tables[f"{root}_sequence_choices_choice"].filter("not is_null")
    position = F.split("path", r"\.")
    items = items.select("sequence_id", position[0].cast("int").alias("choice_no"), position[1].cast("int").alias("item_no"), F.col("type").alias("kind"), F.col("index").alias("idx"))
    members = tables[f"{root}_images"].select("sequence_id", F.lit("image").alias("kind_m"), F.col("index").alias("idx"), F.col("id").alias("element_id"))
    members = members.unionByName(tables[f"{root}_texts"].select("sequence_id", F.lit("text").alias("kind_m"), F.col("index").alias("idx"), F.col("id").alias("element_id")))
    members = members.filter("idx is not null and element_id is not null")
    # every value travels once per (sequence, index); both kinds of an index stay apart until the filter
    fits = (F.col("kind").isNull()) | (F.col("kind") == F.col("kind_m"))
    joined = items.alias("i").join(members.alias("m"), (F.col("i.sequence_id") == F.col("m.sequence_id")) & (F.col("i.idx") == F.col("m.idx")) & fits, "left")
    return joined.select(F.col("i.sequence_id").alias("sequence_id"), "choice_no", "item_no", F.coalesce(F.col("element_id"), F.lit("")).alias("element_id"))
