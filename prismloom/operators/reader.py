"""Point and batch reads by position, row id, value or id.

A stored dataset carries ``pos`` (its order) and ``row_id``; a selector becomes a
semi-join or a pushed-down filter, never a loop. Selectors are checked for their size
before they are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_SELECTORS = 100_000
PUSHED_VALUES = 200


def with_positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` from 0 by ``order``: ranks within range partitions and their offsets,
    so that no task orders the whole table."""
    from pyspark.sql import Window

    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    local = ranged.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__skip")))  # one row per partition
    return local.join(offsets, "__part").withColumn("pos", F.col("__skip") + F.col("__nth") - 1).drop("__part", "__nth", "__skip")


def _selectors(rows: DataFrame, values: list, column: str) -> DataFrame:
    dtype = next(f.dataType for f in rows.schema.fields if f.name == column)
    schema = T.StructType([T.StructField(column, dtype), T.StructField("__ord", T.LongType())])
    # a repeated selector does not multiply rows: its last place counts
    places = {v: i for i, v in enumerate(values)}
    made = rows.sparkSession.createDataFrame(list(places.items()), schema)
    return F.broadcast(made) if len(places) <= BROADCAST_SELECTORS else made


def _project(rows: DataFrame, columns: list[str] | None, force: list[str]) -> list[str]:
    names = columns if columns is not None else rows.columns
    unknown = [c for c in names if c not in rows.columns]
    if unknown:
        raise KeyError(f"no such column: {unknown}")
    return [*names, *[c for c in force if c not in names]]


def take(rows: DataFrame, column: str, values: list, columns: list[str] | None = None, keep_order: bool = False) -> DataFrame:
    """Rows whose ``column`` is one of ``values``, each once; absent values are skipped. With
    ``keep_order`` in the order of the values. The key column is always among the result's."""
    names = _project(rows, columns, [column])
    if not values:
        return rows.select(*names).limit(0)
    if not keep_order and len(values) <= PUSHED_VALUES:
        return rows.select(*names).filter(F.col(column) == values[0] if len(set(values)) == 1 else F.col(column).isin(list(dict.fromkeys(values))))
    joined = rows.select(*names).join(_selectors(rows, values, column), column)
    return (joined.orderBy("__ord") if keep_order else joined).select(*names)


@dataclass
class Ref:
    """A read of one dataset by exactly one kind of selector."""

    path: str
    columns: list[str] | None = None
    indices: list[int] | None = None
    row_ids: list[int] | None = None
    ids: list | None = None
    query: dict[str, list] = field(default_factory=dict)
    keep_order: bool = False

    def selector(self) -> tuple[str, list]:
        if self.row_ids is not None:
            return "row_id", self.row_ids
        if self.indices is not None:
            return "pos", self.indices
        if self.ids is not None:
            return "id", self.ids
        if self.query:
            if len(self.query) != 1:
                raise ValueError("a query names one column")
            return next(iter(self.query.items()))
        raise ValueError("one of row_ids, indices, ids or query is needed")


class Reader:
    """Reads of one or more datasets; handles are kept per path."""

    def __init__(self, spark, load=None):
        self.spark, self._load, self._handles = spark, load or spark.read.parquet, {}

    def open(self, path: str) -> DataFrame:
        if path not in self._handles:
            self._handles[path] = self._load(path)
        return self._handles[path]

    def count(self, path: str) -> int:
        return self.open(path).count()

    def take(self, ref: Ref) -> DataFrame:
        column, values = ref.selector()
        return take(self.open(ref.path), column, values, ref.columns, ref.keep_order)

    def take_all(self, refs: list[Ref]) -> DataFrame | None:
        """Several reads in one table: same columns in all, one kind of selector and key per path."""
        if not refs:
            return None
        if len({tuple(r.columns) if r.columns is not None else None for r in refs}) > 1:
            raise ValueError("all reads must name the same columns")
        by_path: dict[str, dict[str, list]] = {}
        for r in refs:
            column, values = r.selector()
            by_path.setdefault(r.path, {}).setdefault(column, []).extend(values)
        mixed = [p for p, kinds in by_path.items() if len(kinds) > 1]
        if mixed:
            raise ValueError(f"mixed selectors for {mixed}")
        parts = [take(self.open(p), c, v, refs[0].columns) for p, kinds in by_path.items() for c, v in kinds.items()]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result


def blobs_of(ids: DataFrame, blobs: DataFrame, columns: list[str]) -> DataFrame:
    """Blob columns of the given ids. The ids are decided first, so the blob table is read once,
    with the named columns only, against a small side where there is one."""
    return blobs.select("id", *columns).join(ids.select("id").distinct(), "id", "left_semi")
