"""Queries of the general training-data problems (1, 2 and 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eav, orphans, shred
from .registry import Registry, table

general = Registry()

ORPHAN_TABLES = ("sample_annotation_elements", "annotations", "lance_images", "texts", "sample_annotations", "creators", "deleted_ids")

_CELLS = r"""
with s as (
  select sequence_id, id, created_at, value_float, value_json,
    regexp_replace(lower(name), '[^\p{L}\p{N}]', '', 'g') as k,
    trim(value_json) as j
  from sample_annotations where sequence_id is not null and name is not null
), t as (
  select s.*, a.name, a.value_type,
    case when j like '"%' and json_valid(j) then json_extract_string(j, '$') end as str
  from s join attribute_types a on regexp_replace(lower(a.name), '[^\p{L}\p{N}]', '', 'g') = s.k
), n as (
  select t.*,
    case when value_float is not null then
           case when isfinite(value_float) then value_float::double end
         when regexp_full_match(j, '-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?') then try_cast(j as double)
         when str is not null then
           case when regexp_full_match(str, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*') then try_cast(trim(str) as double) end
         when j like '{%' and json_valid(j) and json_type(j, '$.score') in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')
           then try_cast(json_extract_string(j, '$.score') as double) end as num,
    case when value_float is not null then case when value_float in (0, 1) then value_float::double end
         when j in ('true', 'false') then (j = 'true')::int::double
         when lower(str) in ('true', 'yes') then 1.0 when lower(str) in ('false', 'no') then 0.0 end as truth
  from t
), c as (
  select sequence_id, name, value_type, id, created_at, num, truth, str from n where
    (value_type = 'float' and isfinite(num))
    or (value_type = 'integer' and isfinite(num) and num = floor(num))
    or (value_type = 'boolean' and truth is not null)
    or (value_type = 'string' and value_float is null and regexp_matches(str, '[^\s\p{Z}]'))
), r as (
  select *, row_number() over (partition by sequence_id, name order by created_at desc nulls last, id desc) as rn from c
)
"""


@general.add("p1_found", _CELLS + "select sequence_id, name, id as annotation_id from r where rn = 1", "P1")
def p1_found(spark, sf_dir):
    wide = eav.load_wide(spark, table(spark, sf_dir, "sample_annotations"), table(spark, sf_dir, "attribute_types"))
    return wide.cell_sources()


@general.add(
    "p1_wide",
    _CELLS
    + """
select sequence_id,
  max(case when name = 'aesthetic_score' then num end) as aesthetic_score,
  max(case when name = 'object_count' then num end)::bigint as object_count,
  max(case when name = 'is_usable' then truth end)::int as is_usable,
  max(case when name = 'scene_tag' then str end) as scene_tag
from r where rn = 1 group by sequence_id""",
    "P1",
)
def p1_wide(spark, sf_dir):
    wide = eav.load_wide(spark, table(spark, sf_dir, "sample_annotations"), table(spark, sf_dir, "attribute_types"))
    return wide.read().select("sequence_id", "aesthetic_score", "object_count", F.col("is_usable").cast("int").alias("is_usable"), "scene_tag")


_HEX = "lower(regexp_replace(regexp_replace(trim({0}), '^0[xX]', ''), '-', '', 'g'))"


def _canon(col: str) -> str:
    h = _HEX.format(col)
    return f"case when regexp_full_match({h}, '[0-9a-f]{{32}}') then {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] else lower(trim({col})) end"


_ORPHANS = f"""
with recursive refs as (
  select 'sample_annotation_elements' as ref_table, {_canon('sample_annotation_id')} as ref_id, role,
    case lower(trim(element_type)) when 'image' then 'lance_images' when 'text' then 'texts' when 'sample_annotation' then 'sample_annotations' end as tab,
    {_canon('element_id')} as target_id, min(created_at) as ts
  from sample_annotation_elements where element_id is not null group by all
  union all
  select 'annotations', {_canon('id')}, 'creator', 'creators', {_canon('creator_id')} as target_id, min(created_at)
  from annotations where creator_id is not null group by all
), rows_of as (
  select 'lance_images' as tab, {_canon('id')} as id, ingested_at as ts from lance_images
  union all select 'texts', {_canon('id')}, ingested_at from texts
  union all select 'sample_annotations', {_canon('id')}, created_at from sample_annotations
  union all select 'creators', {_canon('id')}, created_at from creators
), targets as (select tab, id, min(ts) as first_at, max(ts) as last_at from rows_of group by all),
gone as (select entity_table as tab, {_canon('entity_id')} as id, max(deleted_at) as deleted_at from deleted_ids group by all),
found as (
  select r.*, case when g.id is not null and not coalesce(t.last_at > g.deleted_at, false) then 'deleted'
                   when t.id is null then 'missing'
                   when t.first_at > r.ts then 'late' end as status
  from refs r left join targets t on t.tab = r.tab and t.id = r.target_id
    left join gone g on g.tab = r.tab and g.id = r.target_id
  where r.tab is not null
)
"""


@general.add("p2_found", _ORPHANS + "select ref_table, ref_id, role, target_id, strftime(ts, '%Y-%m') as period, status from found where status is not null", "P2")
def p2_found(spark, sf_dir):
    return orphans.find_orphans(spark, {t: table(spark, sf_dir, t) for t in ORPHAN_TABLES})


@general.add(
    "p2_report",
    _ORPHANS
    + """, direct as (select * from found where status is not null),
bad(id) as (
  select distinct ref_id from direct where ref_table = 'sample_annotation_elements' and status <> 'late'
  union
  select r.ref_id from refs r join bad b on r.tab = 'sample_annotations' and r.target_id = b.id
), inherited as (
  select r.* from refs r where r.tab = 'sample_annotations' and r.target_id in (select id from bad)
    and not exists (select 1 from direct d where d.status <> 'late' and d.ref_table = r.ref_table and d.ref_id = r.ref_id and d.role = r.role and d.tab = r.tab and d.target_id = r.target_id)
)
select ref_table, strftime(ts, '%Y-%m') as period, 'direct' as origin, status, count(*) as n from direct group by all
union all select ref_table, strftime(ts, '%Y-%m'), 'inherited', 'inherited', count(*) from inherited group by all""",
    "P2",
)
def p2_report(spark, sf_dir):
    return orphans.orphan_report(spark, {t: table(spark, sf_dir, t) for t in ORPHAN_TABLES})


_LATEST = """
with latest as (
  select * from (select *, row_number() over (partition by sequence_id order by create_time desc nulls last) as rn from sequences_data) where rn = 1
), choices as (
  select sequence_id, images, texts, unnest(sequence_choices) as c, generate_subscripts(sequence_choices, 1) as choice_no from latest
), items as (
  select sequence_id, images, texts, choice_no, unnest(c.choice) as i, generate_subscripts(c.choice, 1) as item_no from choices
)
"""


def _flat(spark, sf_dir):
    return shred.shred_latest(spark, table(spark, sf_dir, "sequences_data"), "sequence_id", "seq")


@general.add(
    "p6_found",
    _LATEST
    + """, m as (
  select sequence_id, 'image' as kind, unnest(images) as e from latest union all select sequence_id, 'text', unnest(texts) from
    (select sequence_id, list_transform(texts, lambda x: {'id': x.id, 'width': 0, 'height': 0, 'index': x.index}) as texts from latest)
)
select i.sequence_id, i.choice_no::int as choice_no, i.item_no::int as item_no, coalesce(m.e.id, '') as element_id
from items i left join m on m.sequence_id = i.sequence_id and m.e.index = i.i.index and m.e.id is not null and (i.i.type is null or i.i.type = m.kind)
where i.i is not null""",
    "P6",
)
def p6_found(spark, sf_dir):
    return shred.resolve_members(_flat(spark, sf_dir))


@general.add(
    "p6_tables",
    _LATEST
    + """
select 'seq' as table_name, count(*) as n_rows, count(distinct sequence_id) as n_parents from latest
union all select 'seq_sequence_choices', count(*), count(distinct sequence_id) from choices
union all select 'seq_sequence_choices_choice', count(*), count(distinct sequence_id || '/' || choice_no) from items
union all select 'seq_choices_weights', count(*), count(distinct sequence_id) from (select sequence_id, unnest(choices_weights) from latest)
union all select 'seq_images', count(*), count(distinct sequence_id) from (select sequence_id, unnest(images) from latest)
union all select 'seq_texts', count(*), count(distinct sequence_id) from (select sequence_id, unnest(texts) from latest)""",
    "P6",
)
def p6_tables(spark, sf_dir):
    parts = []
    for name, rows in sorted(_flat(spark, sf_dir).items()):
        parent = F.struct("sequence_id") if name == "seq" else F.struct("sequence_id", "parent_path")
        parts.append(rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(parent).alias("n_parents")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
