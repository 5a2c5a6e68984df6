"""Queries of nested writes, sample transforms, imports, sort orders and annotators, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import reader, sequencing, store, training
from ..operators.store import StoreViews
from ..plans.storage import Workspace
from ..sources import files
from ..streaming import incremental
from .core import STORE
from .registry import Registry, table

samples = Registry()
q = samples.add


def _digest(*parts: str) -> str:
    """An id of contents, as functions.ids.content_id makes it."""
    m = "md5(" + " || ".join(f"coalesce(length({p})::varchar || ':' || {p}, '~')" for p in parts) + ")"
    return f"{m}[1:8] || '-' || {m}[9:12] || '-' || {m}[13:16] || '-' || {m}[17:20] || '-' || {m}[21:32]"


@q(
    "flatten_nested",
    f"""with i as (select source, sequence_id, unnest(images) as e from sequences_data), t as (select source, sequence_id, unnest(texts) as e from sequences_data)
select distinct 'sequence_images' as table_name, {_digest('source', 'sequence_id')} as sequence_id, {_digest('source', 'e.id', 'null::varchar')} as member_id, e.index as idx from i where e is not null
union all select distinct 'sequence_texts', {_digest('source', 'sequence_id')}, {_digest('source', 'e.id', 'e.content')}, e.index from t where e is not null
union all select distinct 'texts', null, {_digest('source', 'e.id', 'e.content')}, e.content from t where e is not null
union all select distinct 'sequences', {_digest('source', 'sequence_id')}, null, source from sequences_data""",
    "DML-6 DML-12 ID-1",
)
def flatten_nested(spark, d):
    """The exports as nested sequences, flattened into rows of every table."""
    none = lambda kind: F.lit(None).cast(kind)
    labels = "array<struct<name:string, meta:string, creator_name:string, creator_meta:string>>"
    whole = lambda c: F.filter(c, lambda e: e.isNotNull())
    image = lambda e: F.struct(F.col("source").alias("source"), e["id"].alias("uri"), none("binary").alias("bytes"), e["width"].alias("width"), e["height"].alias("height"), e["index"].alias("index"), none(labels).alias("annotations"))
    text = lambda e: F.struct(F.col("source").alias("source"), e["id"].alias("uri"), e["content"].alias("content"), e["language"].alias("language"), e["index"].alias("index"), none(labels).alias("annotations"))
    rows = table(spark, d, "sequences_data").select("source", F.col("sequence_id").alias("uri"), none("string").alias("meta"), F.transform(whole("images"), image).alias("images"), F.transform(whole("texts"), text).alias("texts"), none(labels).alias("annotations"))
    flat = store.flatten_sequences(rows)
    shape = lambda name, seq, member, idx: flat[name].select(F.lit(name).alias("table_name"), seq.alias("sequence_id"), member.alias("member_id"), idx.alias("idx"))
    parts = [shape("sequence_images", F.col("sequence_id"), F.col("image_id"), F.col("index")), shape("sequence_texts", F.col("sequence_id"), F.col("text_id"), F.col("index"))]
    parts += [shape("texts", none("string"), F.col("id"), F.col("content")), shape("sequences", F.col("id"), none("string"), F.col("source"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@q("grouped_members", "select user_id::varchar as url, 'd/' || (event_id // 2) as key, string_agg(case event_id % 2 when 0 then 'png' else 'txt' end, ',' order by event_id % 2) as suffixes from events group by 1, 2", "SRC-12")
def grouped_members(spark, d):
    e = F.col("event_id")
    name = F.concat(F.lit("d/"), F.floor(e / 2).cast("string"), F.when(e % 2 == 0, ".PNG").otherwise(".txt"))
    members = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), e.alias("offset"), name.alias("fname"), F.col("event_type").alias("data"))
    return sequencing.group_members(members).select("url", "key", F.array_join(F.array_sort(F.map_keys("members")), ",").alias("suffixes"))


@q("counted_filter", "select id from lance_images where width >= 1024", "FLT-8")
def counted_filter(spark, d):
    return sequencing.counted_filter(table(spark, d, "lance_images"), F.col("width") >= 1024, "wide")[0].select("id")


@q("imported_annotations", "select id, sequence_id, name as value from sample_annotations where sequence_id is not null and name is not null", "SRC-16 SNK-5")
def imported_annotations(spark, d):
    """Annotations written as CSV and imported; rows without sequence or value are set apart."""
    path = Workspace(spark, "import").fresh("csv")
    files.write_rows(table(spark, d, "sample_annotations").select("id", "sequence_id", F.col("name").alias("value")), path, "csv")
    return files.import_annotations(spark, path, "csv")[0].select("id", "sequence_id", "value")


@q("mapped_samples", "select event_id as __key__, upper(event_type) as kind, length(event_type)::bigint as n from events where event_id % 3 <> 0", "PRJ-3")
def mapped_samples(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("__key__"), "event_type")
    keep = lambda s: None if s["__key__"] % 3 == 0 else {"kind": s["event_type"].upper(), "n": len(s["event_type"])}
    return sequencing.map_samples(rows, keep, "kind string, n long")


@q("assigned_keys", "select event_id, event_type, event_type || '-' || user_id as tag, try_cast(event_type as bigint) as number from events", "PRJ-4")
def assigned_keys(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return sequencing.assign(rows, tag=F.concat_ws("-", "event_type", "user_id"), number=F.col("event_type").try_cast("bigint")).drop("user_id")


@q("ordered_fields", "select id, coalesce(uri, '~') || '|' || coalesce(source, '~') || '|' || coalesce(width::varchar, '~') as fields from lance_images", "PRJ-11")
def ordered_fields(spark, d):
    rows = table(spark, d, "lance_images")
    listed = sequencing.as_list(rows, ["uri", "source", "width"])
    return rows.select("id", F.array_join(listed, "|", "~").alias("fields"))


@q("blobs_by_id", "select id, lower(hex(file_hash)) as hash from lance_images where source = 'ferncap'", "JN-24 STR-14")
def blobs_by_id(spark, d):
    rows = table(spark, d, "lance_images")
    return reader.blobs_of(rows.filter("source = 'ferncap'").select("id"), rows, ["file_hash"]).select("id", F.lower(F.hex("file_hash")).alias("hash"))


@q("take_by_row_ids", "with r as (select id, row_number() over (order by id) + 999 as row_id from lance_images) select id, row_id from r where row_id in (1000, 1007, 1002)", "SRC-3")
def take_by_row_ids(spark, d):
    """Row ids are written with the rows and do not follow their position on disk."""
    space = Workspace(spark, "rowids")
    rows = reader.with_positions(table(spark, d, "lance_images").select("id"), ["id"])
    path = space.fresh("rows")
    rows.select("id", (F.col("pos") + 1000).alias("row_id")).write.parquet(path)
    return reader.Reader(spark).take(reader.Ref(path, columns=["id"], row_ids=[1007, 1000, 1002, 999]))


@q("numeric_first_order", "with k as (select distinct event_type || case when user_id % 3 > 0 then (user_id % 50)::varchar else '' end as key from events) select key, row_number() over (order by (regexp_extract(key, '\\d+') = '')::int, try_cast(nullif(regexp_extract(key, '\\d+'), '') as bigint), key)::int as place from k", "SRT-2")
def numeric_first_order(spark, d):
    from pyspark.sql import Window

    key = F.concat("event_type", F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 50).cast("string")).otherwise(""))
    keys = table(spark, d, "events").select(key.alias("key")).distinct()
    return keys.select("key", F.row_number().over(Window.orderBy(*tx.numeric_first(F.col("key")))).alias("place"))


@q("id_positions", "select id, row_number() over (order by id) - 1 as pos from texts", "SRT-3")
def id_positions(spark, d):
    """Positions by id as an unsigned 128-bit number, which is the order of its canonical text."""
    return reader.with_positions(table(spark, d, "texts").select("id"), ["id"])


@q("scenarios", "select event_id, case event_id % 3 when 0 then event_type when 1 then 'plain ' || event_type else '{\"cn\": \"x\"}' end as en from events", "STR-7")
def scenarios(spark, d):
    e, t = F.col("event_id") % 3, F.col("event_type")
    raw = F.when(e == 0, F.concat(F.lit('Sure:\n```json\n{"en": " '), t, F.lit(' ", "cn": "y"}\n```'))).when(e == 1, F.concat(F.lit(" plain "), t)).otherwise('{"cn": "x"}')
    return table(spark, d, "events").select("event_id", tx.scenario(raw, "en").alias("en"))


@q("pair_keys", "select doc_id, split_part(source || '__' || kind, '__', 1) as content, split_part(source || '__' || kind, '__', 2) as style from documents where source is not null and kind is not null", "STR-12")
def pair_keys(spark, d):
    rows = table(spark, d, "documents").filter("source is not null and kind is not null")
    content, style = tx.pair_parts(F.concat_ws("__", "source", "kind"))
    return rows.select("doc_id", content.alias("content"), style.alias("style"))


_ENDS = "arg_max(e.id, e.index || chr(1) || e.id) filter (where contains(e.index, '{0}') or contains(e.index, '{1}'))"


@q("source_target", STORE + f", m as (select sequence_id, unnest(images) as e from latest) select sequence_id, {_ENDS.format('prev', 'source')} as source_id, {_ENDS.format('current', 'target')} as target_id from m where e.id is not null and e.index is not null group by 1", "STR-17")
def source_target(spark, d):
    rows = StoreViews(spark, d).exports().select("sequence_id", F.filter("images", lambda e: e["index"].isNotNull() & e["id"].isNotNull()).alias("images")).filter("size(images) > 0")
    source, target = training.pick_source_target(F.col("images"))
    return rows.select("sequence_id", source.alias("source_id"), target.alias("target_id"))


@q("cyclic_style", "select doc_id, source || ' ' || (['Style A.', 'Style B.', 'Style C.'])[doc_id % 3 + 1] as caption from documents where source is not null", "STR-24")
def cyclic_style(spark, d):
    rows = table(spark, d, "documents").filter("source is not null")
    return rows.select("doc_id", tx.cyclic_sentence(F.col("source"), ["Style A.", "Style B.", "Style C."], F.col("doc_id")).alias("caption"))


@q("merged_shards", "select distinct id, source from lance_images", "SNK-10")
def merged_shards(spark, d):
    """Two overlapping shards as one dataset that replaces what was there."""
    space = Workspace(spark, "merge")
    rows = table(spark, d, "lance_images").select("id", "source")
    shards = [space.fresh("shard") for _ in range(2)]
    for i, path in enumerate(shards):
        rows.filter(F.pmod(F.crc32("id"), F.lit(3)) != i).write.parquet(path)
    target = space.fresh("merged")
    files.merge_shards(spark, shards, target)
    return spark.read.parquet(target)


@q("canonical_json", "select event_id, '{\"a\":\"' || event_type || '\",\"b\":[' || user_id || ',null],\"ü\":1}' as text from events", "JSN-1")
def canonical_json(spark, d):
    raw = F.concat(F.lit('{ "ü" : 1, "b": ['), F.col("user_id").cast("string"), F.lit(', null], "a": "'), F.col("event_type"), F.lit('"}'))
    return table(spark, d, "events").select("event_id", tx.canonical_json(raw).alias("text"))


@q("annotated", "select event_id as key, case when event_id % 7 <> 0 then value * 2 end as result, case when event_id % 7 = 0 then 'ValueError: seventh' end as error from events", "UDF-1 UDF-6 SNK-7 STM-2 STM-4 STM-6 AGG-24")
def annotated(spark, d):
    """An annotator over all rows, broken off after the rows with even keys and resumed."""
    output = Workspace(spark, "annotate").fresh("output")
    rows = table(spark, d, "events").select(F.col("event_id").alias("key"), "value")

    def double(row: dict) -> float:
        if row["key"] % 7 == 0:
            raise ValueError("seventh")
        return row["value"] * 2

    incremental.run_annotator(spark, rows.filter("key % 2 = 0"), output, double, "double", retries=0)
    incremental.run_annotator(spark, rows, output, double, "double", retries=1, delay=0.0)
    return spark.read.parquet(output).select("key", "result", "error")
