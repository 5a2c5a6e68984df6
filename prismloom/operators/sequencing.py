"""Ordered streams of samples: grouping, filters, routing and side data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_groups(rows: DataFrame, stream: str, order: list[str], group: str, max_size: int | None = None) -> DataFrame:
    """Consecutive rows with one group value: adds run_no (from 1 within the stream) and, where a
    run is longer than ``max_size``, chunk_no. The window needs a stream column, so that one
    stream and not the table is ordered in a task."""
    by = Window.partitionBy(stream).orderBy(*order)
    changed = F.lag(group).over(by).eqNullSafe(F.col(group)) & (F.row_number().over(by) > 1)
    marked = rows.withColumn("__new", (~changed).cast("int"))
    runs = marked.withColumn("run_no", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    if max_size is None:
        return runs
    place = F.row_number().over(Window.partitionBy(stream, "run_no").orderBy(*order))
    return runs.withColumn("chunk_no", F.floor((place - 1) / max_size).cast("int"))


def group_members(files: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """``files``: url, offset, fname, data. Successive members whose path differs only in the last
    extension form a sample: url, key, members (map of lower-case suffix to data). Twice the same
    suffix in one sample is an error; samples marked bad and empty ones are dropped."""
    base = F.regexp_extract("fname", r"^((?:.*/)?[^/.]*(?:\.[^/.]*)*?)\.([^/.]+)$", 1)
    suffix = F.lower(F.regexp_extract("fname", r"\.([^/.]+)$", 1))
    keyed = files.select("url", "offset", base.alias("key"), suffix.alias("suffix"), "data").filter("suffix <> ''")
    runs = run_groups(keyed, "url", ["offset"], "key")
    if suffixes is not None:
        runs = runs.filter(F.col("suffix").isin([s.lower() for s in suffixes]))
    members = F.collect_list(F.struct("suffix", "data"))
    grouped = runs.groupBy("url", "run_no", "key").agg(members.alias("m"), F.count_distinct("suffix").alias("n"))
    checked = F.when(F.size("m") > F.col("n"), F.raise_error(F.concat(F.lit("duplicate suffix in sample "), F.col("key")))).otherwise(F.map_from_entries("m"))
    return grouped.select("url", "key", checked.alias("members")).filter("not map_contains_key(members, '__bad__')")


def in_range(rules: dict[str, tuple[float | None, float | None]], columns: list[str], allow_missing: bool | set[str] = False) -> Column:
    """Inclusive bounds, None is open. A null value or a missing column fails unless allowed."""
    ok = F.lit(True)
    for name, (low, high) in rules.items():
        allowed = name in allow_missing if isinstance(allow_missing, (set, frozenset)) else allow_missing
        if name not in columns:
            ok = ok & F.lit(bool(allowed))
            continue
        v = F.col(f"`{name}`")
        # plain comparisons, so that they are pushed down to the scan
        test = v.isNotNull()
        if low is not None:
            test = test & (v >= low)
        if high is not None:
            test = test & (v <= high)
        ok = ok & (v.isNull() | test) if allowed else ok & test
    return ok


def has_keys(keys: list[str], columns: list[str]) -> Column:
    ok = F.lit(True)
    for k in keys:
        ok = ok & (F.col(f"`{k}`").isNotNull() if k in columns else F.lit(False))
    return ok


def counted_filter(rows: DataFrame, predicate: Column, name: str = "filter"):
    """Filter with the numbers of rows seen and passed, read from the returned observation after an action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("seen"), F.count_if(predicate).alias("passed")).filter(predicate), seen


def keep_columns(rows: DataFrame, names: list[str], meta: bool = True) -> DataFrame:
    """Listed columns, in their order; missing ones are ignored. Meta columns (__x__) stay on request."""
    chosen = [n for n in names if n in rows.columns]
    if meta:
        chosen += [c for c in rows.columns if c.startswith("__") and c.endswith("__") and c not in chosen]
    return rows.select(*[F.col(f"`{c}`") for c in chosen])


def map_samples(rows: DataFrame, fn, schema: str, key: str = "__key__") -> DataFrame:
    """Each row through ``fn`` (dict to dict, None drops the row) in Arrow batches; the key stays."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for batch in batches:
            made = [(s[key], fn(s)) for s in batch.to_dict("records")]
            yield pd.DataFrame([{key: k} | m for k, m in made if m is not None], columns=[key, *names])

    names = list(T.StructType.fromDDL(schema).names)
    return rows.mapInPandas(run, f"`{key}` {kind}, {schema}")


def assign(rows: DataFrame, **columns: Column) -> DataFrame:
    """Computed columns, each from the columns before; an expression that may fail belongs in its try_ form."""
    for name, value in columns.items():
        rows = rows.withColumn(name, value)
    return rows


def as_list(rows: DataFrame, names: list[str]) -> Column:
    """Root fields as texts in the order of ``names``; one the rows lack is null."""
    return F.array(*[F.col(f"`{n}`").cast("string") if n in rows.columns else F.lit(None).cast("string") for n in names])


def route(rows: DataFrame, router: Column, branches: dict[str, object]) -> DataFrame:
    """Each row through the branch (DataFrame -> DataFrame) its router names; ``__default__`` takes
    the rest, without it an unknown route is an error."""
    named = rows.withColumn("__route", router)
    known = [b for b in branches if b != "__default__"]
    parts = [fn(named.filter(F.col("__route") == b).drop("__route")) for b, fn in branches.items() if b != "__default__"]
    other = named.filter(F.col("__route").isNull() | ~F.col("__route").isin(known))
    if "__default__" in branches:
        parts.append(branches["__default__"](other.drop("__route")))
    else:
        # filter keeps nothing; it only fails when such a row exists
        guard = named.filter(F.when(F.col("__route").isNull() | ~F.col("__route").isin(known), F.raise_error(F.concat(F.lit("no route "), F.coalesce("__route", F.lit("null"))))).otherwise(F.lit(False)).cast("boolean"))
        parts.append(guard.drop("__route").select(*parts[0].columns) if set(parts[0].columns) <= set(guard.columns) else parts[0].limit(0))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def attach(rows: DataFrame, side: DataFrame, key: str = "key", prefix: str = "", fallback: Column | None = None) -> DataFrame:
    """Left join with side data; keys that occur twice there are dropped whole. ``fallback`` is
    looked up where the key itself has no match."""
    single = side.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(f"{prefix}{c}") for c in side.columns if c != key]).filter("__n = 1").drop("__n")
    joined = rows.join(single, key, "left")
    if fallback is None:
        return joined
    names = [f"{prefix}{c}" for c in side.columns if c != key]
    second = single.select(F.col(key).alias("__fb"), *[F.col(n).alias(f"__fb_{n}") for n in names])
    both = joined.withColumn("__k", fallback).join(second, F.col("__k") == F.col("__fb"), "left")
    return both.select(*rows.columns, *[F.coalesce(n, f"__fb_{n}").alias(n) for n in names])


def unique_keys(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once."""
    single = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").select(key)
    return rows.join(single, key, "left_semi")


def odd_keys(rows: DataFrame, key: str, order: str) -> DataFrame:
    """'Drop on duplicate' taken literally: each second occurrence removes the key again, so keys
    with an odd count survive, with their last row."""
    kept = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.struct(*rows.columns), order).alias("__r")).filter("__n % 2 = 1")
    return kept.select("__r.*")


def interleave(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` streams (rows by key, strided) mixed at random: ``turn`` is each row's place in the whole, by a
    seeded md5 that any engine can reproduce. The order is made by range partitions, so no task sorts a stream."""
    from .reader import with_positions

    at = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    mixed = rows.withColumn("stream", F.pmod(F.col(key), F.lit(n)).cast("int")).withColumn("__at", at)
    return with_positions(mixed, ["__at", key]).drop("__at").withColumnRenamed("pos", "turn")


def prefix_groups(files: DataFrame, prompts: DataFrame, last: bool = True) -> DataFrame:
    """``files``: path; ``prompts``: key, prompt. Files of one name prefix (before the last or the
    first '_') with their prompt: key, prompt, paths."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    prefix = F.regexp_extract(stem, r"^(.*)_[^_]*$", 1) if last else F.regexp_extract(stem, r"^([^_]*)_", 1)
    grouped = files.select(prefix.alias("key"), "path").filter("key <> ''").groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return grouped.join(prompts, "key").select("key", "prompt", "paths")
