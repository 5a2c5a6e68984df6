"""Queries over the store: statistics, reads, annotation analytics and profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as ann
from ..operators import profile, stats, views
from ..operators.store import StoreViews
from .registry import Registry

core = Registry()

STORE = """with latest as (
  select * from (select *, row_number() over (partition by sequence_id order by create_time desc nulls last) as rn from sequences_data) where rn = 1
), sequences as (select sequence_id as id, uri, source, task_type from latest),
sequence_images as (select distinct sequence_id, m.id as image_id, m.index as "index" from (select sequence_id, unnest(images) as m from latest) where m.id is not null and m.index is not null),
sequence_texts as (select distinct sequence_id, m.id as text_id, m.index as "index" from (select sequence_id, unnest(texts) as m from latest) where m.id is not null and m.index is not null),
images as (select id, uri, source, width, height from lance_images),
sa as (select distinct id, name, creator_id, sequence_id, value_float, value_json, case when not isnan(value_float) then value_float::double end as v from sample_annotations),
el as (select distinct sample_annotation_id, element_id, element_type, role from sample_annotation_elements),
labels as (select distinct id, name, type, creator_id, meta from annotations)
"""


def _spread(name: str, v: str) -> str:
    return f"round(avg({v}), 2) as avg_{name}, min({v}) as min_{name}, max({v}) as max_{name}, median({v}) as median_{name}, round(stddev_samp({v}), 2) as std_{name}"


def _total(cols: str, rows: str) -> str:
    return f"{STORE} select coalesce(source, 'Overall Total') as source, grouping(source)::int as is_total, {cols} from {rows} group by grouping sets ((source), ())"


@core.add(
    "stat_images",
    _total(
        f"count(*) as n_images, {_spread('width', 'width::double')}, {_spread('height', 'height::double')}, round(avg(width::double * height), 0) as avg_area, min(width::double * height) as min_area, max(width::double * height) as max_area, median(width::double * height) as median_area, round(avg(width::double / height), 2) as avg_aspect, round(median(width::double / height), 2) as median_aspect",
        "images where height > 0",
    ),
    "AGG-1 FLT-6 MTH-1",
)
def stat_images(spark, d):
    return stats.image_stats(StoreViews(spark, d).images())


@core.add("stat_texts", _total(f"count(*) as n_texts, {_spread('length', 'length(content)::double')}", "texts"), "AGG-2")
def stat_texts(spark, d):
    return stats.text_stats(StoreViews(spark, d).texts())


@core.add(
    "stat_sequences",
    STORE
    + f""", c as (select s.id, s.source, coalesce(i.n, 0) as n_img, coalesce(t.n, 0) as n_txt from sequences s
  left join (select sequence_id, count(distinct image_id) as n from sequence_images group by 1) i on i.sequence_id = s.id
  left join (select sequence_id, count(distinct text_id) as n from sequence_texts group by 1) t on t.sequence_id = s.id)
select coalesce(source, 'Overall Total') as source, grouping(source)::int as is_total, count(*) as n_sequences, sum(n_img)::bigint as sum_images, {_spread('images', 'n_img::double')}, sum(n_txt)::bigint as sum_texts, {_spread('texts', 'n_txt::double')}
from c group by grouping sets ((source), ())""",
    "AGG-3 JN-2",
)
def stat_sequences(spark, d):
    v = StoreViews(spark, d)
    return stats.sequence_stats(v.sequences(), v.sequence_images(), v.sequence_texts())


@core.add("distinct_sources", "select distinct source from lance_images where source is not null and source <> ''", "AGG-5 FLT-5")
def distinct_sources(spark, d):
    return stats.distinct_sources(StoreViews(spark, d).images())


@core.add("describe_dims", "with p as (select 'width' as column_name, width::double as v from lance_images union all select 'height', height from lance_images union all select 'file_size', file_size / 1024 from lance_images union all select 'clarity', clarity from lance_images) select column_name, count(*) as n, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, min(v) as min, round(quantile_cont(v, 0.25), 4) as p25, round(quantile_cont(v, 0.5), 4) as p50, round(quantile_cont(v, 0.75), 4) as p75, max(v) as max from p where v is not null and not isnan(v) group by 1", "AGG-15")
def describe_dims(spark, d):
    rows = StoreViews(spark, d).blobs().withColumn("file_size", F.col("file_size") / 1024)
    return stats.describe(rows, ["width", "height", "file_size", "clarity"])


@core.add("members_describe", STORE + ", c as (select sequence_id, count(*)::double as n from sequence_images group by 1) select 'n_images' as column_name, count(*) as n, round(avg(n), 4) as mean, round(stddev_samp(n), 4) as std, min(n) as min, round(quantile_cont(n, 0.25), 4) as p25, round(quantile_cont(n, 0.5), 4) as p50, round(quantile_cont(n, 0.75), 4) as p75, max(n) as max from c", "AGG-13")
def members_describe(spark, d):
    return stats.describe(profile.members_per_sequence(StoreViews(spark, d).sequence_images()), ["n_images"])


@core.add(
    "length_distribution",
    STORE
    + ", c as (select sequence_id, count(*) as n from sequence_images group by 1), b(label, lo, hi) as (values ('(0,1]', 0, 1), ('(1,5]', 1, 5), ('(5,10]', 5, 10), ('(10,20]', 10, 20), ('(20,50]', 20, 50), ('(50,inf]', 50, 1000000000)) select label, count(c.n) as n from b left join c on c.n > lo and c.n <= hi group by label",
    "AGG-14",
)
def length_distribution(spark, d):
    return stats.count_histogram(profile.members_per_sequence(StoreViews(spark, d).sequence_images()), "n_images")


@core.add(
    "score_histogram",
    STORE
    + ", x as (select v from sa where name = 'clip_score' and v is not null), m as (select min(v) as a, max(v) as b from x) select least(10, greatest(1, ceil((v - a) / ((b - a) / 10))))::int as bin, count(*) as n from x, m group by 1",
    "AGG-19",
)
def score_histogram(spark, d):
    return stats.equal_width_histogram(StoreViews(spark, d).sample_annotations().filter("name = 'clip_score'"), "value_float", 10)


# -- reads --------------------------------------------------------------------------
@core.add(
    "sequence_view",
    STORE
    + """, i as (select si.sequence_id, count(*) as n, string_agg(si.index || ':' || si.image_id || ':' || im.width || 'x' || im.height, ',' order by si.index, si.image_id) as txt from sequence_images si join images im on im.id = si.image_id group by 1),
t as (select st.sequence_id, count(*) as n, string_agg(st.index || ':' || st.text_id, ',' order by st.index, st.text_id) as txt from sequence_texts st join texts on texts.id = st.text_id group by 1)
select s.id as sequence_id, s.uri, s.source, i.n as n_images, t.n as n_texts, i.txt as images, t.txt as texts from sequences s left join i on i.sequence_id = s.id left join t on t.sequence_id = s.id""",
    "JN-1 AGG-4 PRJ-12",
)
def sequence_view(spark, d):
    return _flat_view(spark, d)


def _flat_view(spark, d, sources=None):
    v = StoreViews(spark, d)
    seq = v.sequences() if sources is None else views.by_values(v.sequences(), "source", sources)
    nested = views.sequence_view(seq, v.sequence_images(), v.sequence_texts(), v.images(), v.texts())
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return nested.select(
        "sequence_id",
        "uri",
        "source",
        size("images").alias("n_images"),
        size("texts").alias("n_texts"),
        F.array_join(F.transform("images", lambda e: F.concat(e["index"], F.lit(":"), e["id"], F.lit(":"), e["width"].cast("string"), F.lit("x"), e["height"].cast("string"))), ",").alias("images"),
        F.array_join(F.transform("texts", lambda e: F.concat(e["index"], F.lit(":"), e["id"])), ",").alias("texts"),
    )


SOME_SOURCES = ["lumen_edit", "harbor_t2i", "ferncap"]
_IN = "('lumen_edit', 'harbor_t2i', 'ferncap')"


@core.add("sequences_by_source", f"{STORE} select id from sequences where source in {_IN}", "FLT-1 FLT-2 FLT-12")
def sequences_by_source(spark, d):
    return views.by_values(StoreViews(spark, d).sequences(), "source", SOME_SOURCES).select("id")


@core.add("ids_by_uri", "select uri, max(id) as id from lance_images where uri is not null and source = 'lumen_edit' group by 1", "JN-21 FLT-2")
def ids_by_uri(spark, d):
    return views.uri_ids(StoreViews(spark, d).images(), "lumen_edit")


@core.add("images_of_sources", f"{STORE} select distinct si.sequence_id, si.image_id, im.uri from sequences s join sequence_images si on si.sequence_id = s.id join images im on im.id = si.image_id where s.source in {_IN}", "JN-3")
def images_of_sources(spark, d):
    v = StoreViews(spark, d)
    return views.images_of_sources(v.sequences(), v.sequence_images(), v.images(), SOME_SOURCES)


@core.add("image_text_pairs", STORE + """ select si.sequence_id, si.image_id, si."index" as image_role, st.text_id, st."index" as text_role from sequence_images si join sequence_texts st on st.sequence_id = si.sequence_id where st."index" like '%_en%'""", "JN-4 FLT-4")
def image_text_pairs(spark, d):
    v = StoreViews(spark, d)
    return views.image_text_pairs(v.sequence_images(), v.sequence_texts(), "%_en%")


@core.add("role_triples", STORE + """ select a.sequence_id, a.image_id as source_image, b.image_id as target_image, t.text_id from sequence_images a join sequence_images b on b.sequence_id = a.sequence_id and b."index" = 'target' join sequence_texts t on t.sequence_id = a.sequence_id and t."index" like '%instruction%' where a."index" = 'source'""", "JN-5 FLT-4")
def role_triples(spark, d):
    v = StoreViews(spark, d)
    return views.role_triples(v.sequence_images(), v.sequence_texts(), "source", "target", "%instruction%")


@core.add("bilingual_captions", STORE + """ select distinct a.sequence_id, x.content as caption_cn, y.content as caption_en from sequence_texts a join texts x on x.id = a.text_id join sequence_texts b on b.sequence_id = a.sequence_id and b."index" = 'primary_description_en' join texts y on y.id = b.text_id where a."index" = 'primary_description_cn'""", "JN-6")
def bilingual_captions(spark, d):
    v = StoreViews(spark, d)
    return views.bilingual(v.sequence_texts(), v.texts(), "primary_description_cn", "primary_description_en")


@core.add("captions_by_source", STORE + f""" select st.sequence_id, st.text_id, x.content from sequence_texts st join sequences s on s.id = st.sequence_id join texts x on x.id = st.text_id where st."index" = 'primary_description_en' and s.source in {_IN}""", "JN-7")
def captions_by_source(spark, d):
    v = StoreViews(spark, d)
    seq = views.by_values(v.sequences(), "source", SOME_SOURCES).select(F.col("id").alias("sequence_id"))
    st = v.sequence_texts().filter("index = 'primary_description_en'").join(seq, "sequence_id", "left_semi")
    return st.join(v.texts().select(F.col("id").alias("text_id"), "content"), "text_id").select("sequence_id", "text_id", "content")


@core.add("labelled_sequences_having", STORE + " select si.sequence_id, count(distinct si.image_id) as n_images from sequence_images si where si.image_id in (select element_id from el where element_type = 'image') group by 1 having count(distinct si.image_id) >= 2", "JN-8 AGG-11")
def labelled_sequences_having(spark, d):
    v = StoreViews(spark, d)
    return views.labelled_sequences(v.sequence_images(), v.elements(), 2)


@core.add("labels_with_creator", STORE + " select l.id, l.name, l.type, c.name as creator_name from labels l left join (select distinct id, name from creators) c on c.id = l.creator_id", "JN-9")
def labels_with_creator(spark, d):
    v = StoreViews(spark, d)
    return views.labels_with_creator(v.annotations(), v.creators())


@core.add("sequences_of_images", STORE + " select image_id, count(distinct sequence_id) as n, string_agg(distinct sequence_id, ',' order by sequence_id) as sequences from sequence_images group by 1", "AGG-26")
def sequences_of_images(spark, d):
    return views.sequences_of_images(StoreViews(spark, d).sequence_images()).select("image_id", F.size("sequences").cast("long").alias("n"), F.array_join("sequences", ",").alias("sequences"))


@core.add("first_source_match", "with k as (select distinct uri as key from texts where uri is not null), a as (select uri as key, min(id) as v from texts where language = 'en' group by 1), b as (select uri as key, min(id) as v from texts where language = 'zh' group by 1) select k.key, coalesce(a.v, b.v) as value from k left join a using (key) left join b using (key)", "JN-23")
def first_source_match(spark, d):
    t = StoreViews(spark, d).texts().filter("uri is not null").withColumnsRenamed({"uri": "key", "id": "value"})
    return views.first_source_match(t.select("key").distinct(), t.filter("language = 'en'").select("key", "value"), t.filter("language = 'zh'").select("key", "value"))


# -- annotations --------------------------------------------------------------------
_STATS = "count(v) as n, min(v) as min_value, max(v) as max_value, round(avg(v), 6) as avg_value, round(stddev_samp(v), 6) as std_value"


@core.add("annotation_summary", STORE + " select name, count(*) as n, count(distinct creator_id) as n_creators, count(distinct sequence_id) as n_sequences, min(v) as min_value, max(v) as max_value, round(avg(v), 6) as avg_value from sa group by name", "AGG-6")
def annotation_summary(spark, d):
    return ann.overview(StoreViews(spark, d).sample_annotations())


@core.add("value_stats", STORE + f" select {_STATS} from sa where name = 'aesthetic_score'", "AGG-7")
def value_stats(spark, d):
    return ann.value_stats(StoreViews(spark, d).sample_annotations(), "aesthetic_score")


@core.add("annotation_by_creator", STORE + f" select c.name as creator_name, {_STATS} from sa join creators c on c.id = sa.creator_id where sa.name = 'clip_score' group by 1", "AGG-8")
def annotation_by_creator(spark, d):
    v = StoreViews(spark, d)
    return ann.by_creator(v.sample_annotations(), v.creators(), "clip_score")


@core.add("score_by_source", STORE + " select im.source, count(*) as n, round(avg(sa.v), 6) as avg_value from sa join el on el.sample_annotation_id = sa.id and el.element_type = 'image' join images im on im.id = el.element_id where sa.name = 'clip_score' group by 1", "AGG-9 JN-11")
def score_by_source(spark, d):
    v = StoreViews(spark, d)
    return ann.score_by_source(v.sample_annotations(), v.elements(), v.images(), "clip_score")


@core.add("score_buckets", STORE + " select case when v > 0.8 then 'High' when v > 0.6 then 'Medium' else 'Low' end as bucket, count(*) as n, round(avg(v), 6) as avg_value from sa where name = 'style_similarity' group by 1", "AGG-10")
def score_buckets(spark, d):
    return ann.score_buckets(StoreViews(spark, d).sample_annotations(), "style_similarity")


@core.add("high_scores_topk", STORE + " select id, sequence_id, v as value from sa where name = 'aesthetic_score' and v > 0.7 order by v desc, id limit 100", "FLT-3 LIM-1 SRT-4")
def high_scores_topk(spark, d):
    return ann.top_scores(StoreViews(spark, d).sample_annotations(), "aesthetic_score", 0.7, 100)


@core.add("annotation_export", STORE + " select sa.id, sa.name, sa.sequence_id, case when not isnan(sa.value_float) then sa.value_float end as value_float, sa.value_json, c.name as creator_name, el.element_id, el.element_type, el.role from sa join creators c on c.id = sa.creator_id join el on el.sample_annotation_id = sa.id", "JN-10 SNK-5")
def annotation_export(spark, d):
    v = StoreViews(spark, d)
    return ann.export(v.sample_annotations(), v.creators(), v.elements())


@core.add("annotation_export_elements", STORE + " select sa.id, sa.name, sa.sequence_id, case when not isnan(sa.value_float) then sa.value_float end as value_float, sa.value_json, c.name as creator_name, el.element_id, el.element_type, el.role from sa left join creators c on c.id = sa.creator_id left join el on el.sample_annotation_id = sa.id", "JN-10")
def annotation_export_elements(spark, d):
    v = StoreViews(spark, d)
    return ann.export(v.sample_annotations(), v.creators(), v.elements(), "left")


@core.add("two_criteria_images", STORE + " select distinct element_id from el where element_type = 'image' and sample_annotation_id in (select id from sa where name = 'clip_score' and v > 0.5) and element_id in (select element_id from el where element_type = 'image' and sample_annotation_id in (select id from sa where name = 'aesthetic_score' and v > 0.5))", "JN-12")
def two_criteria_images(spark, d):
    v = StoreViews(spark, d)
    return ann.annotated_twice(v.sample_annotations(), v.elements(), ("clip_score", 0.5), ("aesthetic_score", 0.5))


@core.add("not_yet_annotated", STORE + " select s.id from sequences s where not exists (select 1 from sa where sa.sequence_id = s.id and sa.name = 'clip_score')", "JN-13 JN-15 STM-2 FLT-11")
def not_yet_annotated(spark, d):
    v = StoreViews(spark, d)
    return ann.not_yet_annotated(v.sequences(), v.sample_annotations(), "clip_score")


@core.add("zscore_outliers", STORE + ", x as (select id, sequence_id, v, avg(v) over () as mean, stddev_samp(v) over () as std from sa where name = 'noise_level' and v is not null) select id, sequence_id, round(v, 6) as value, round((v - mean) / std, 6) as z from x where abs(round((v - mean) / std, 6)) > 1.5", "WIN-2")
def zscore_outliers(spark, d):
    return ann.zscore_outliers(StoreViews(spark, d).sample_annotations(), "noise_level", 1.5)


@core.add("tag_counts", STORE + ", t as (select coalesce(nullif(case when value_json like '\"%' then json_extract_string(value_json, '$') end, ''), '未标注') as tag from sa where name = 'scene_tag') select tag, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as pct from t group by tag", "AGG-22")
def tag_counts(spark, d):
    rows = StoreViews(spark, d).sample_annotations().filter("name = 'scene_tag'")
    return ann.tag_counts(rows, F.when(F.col("value_json").startswith('"'), F.get_json_object("value_json", "$")))


@core.add("multi_tag_counts", "with t as (select unnest(from_json(json_extract(content, '$.tags'), '[\"VARCHAR\"]')) as tag from texts where content like '{%' and json_valid(content) and json_type(content, '$.tags') = 'ARRAY') select tag, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as pct from t group by tag", "AGG-22")
def multi_tag_counts(spark, d):
    rows = StoreViews(spark, d).texts().filter(F.col("content").startswith("{"))
    return ann.multi_tag_counts(rows, F.from_json(F.get_json_object("content", "$.tags"), "array<string>"))


@core.add("cross_tab_topk", STORE + ", t as (select case when value_json like '\"%' then json_extract_string(value_json, '$') end as tag, s.source as \"group\" from sa join sequences s on s.id = sa.sequence_id where sa.name = 'camera_tag'), c as (select \"group\", tag, count(*) as n from t group by all) select * from (select *, row_number() over (partition by \"group\" order by n desc, tag asc nulls first)::int as rank from c) where rank <= 5", "AGG-23")
def cross_tab_topk(spark, d):
    v = StoreViews(spark, d)
    tags = v.sample_annotations().filter("name = 'camera_tag'").select("sequence_id", F.when(F.col("value_json").startswith('"'), F.get_json_object("value_json", "$")).alias("tag"))
    rows = tags.join(v.sequences().select(F.col("id").alias("sequence_id"), F.col("source").alias("group")), "sequence_id")
    return ann.cross_top(rows, "group", "tag", 5)


@core.add("elements_annotations", STORE + " select element_id, id, name from (select element_id, sa.id, sa.name, row_number() over (partition by element_id order by sa.id desc, sa.name desc) as rn from el join sa on sa.id = el.sample_annotation_id where element_id in (select element_id from el order by element_id limit 50)) where rn = 1", "JN-25")
def elements_annotations(spark, d):
    v = StoreViews(spark, d)
    wanted = [r.element_id for r in v.elements().select("element_id").orderBy("element_id").limit(50).collect()]
    return ann.annotations_of_elements(v.sample_annotations(), v.elements(), wanted).select("element_id", "id", "name")


# -- profile ------------------------------------------------------------------------
@core.add("duplicate_profile", "with p as (select 'id' as column_name, id as v from lance_images union all select 'file_hash', hex(file_hash) from lance_images union all select 'pdq_hash', hex(pdq_hash) from lance_images), c as (select column_name, v, count(*) as n from p where v is not null group by all) select column_name, sum(n)::bigint as n_rows, count(*) as n_distinct, count(*) filter (where n > 1) as n_repeated, coalesce(sum(n) filter (where n > 1), 0)::bigint as rows_repeated, round(count(*) / sum(n), 6) as unique_ratio from c group by 1", "AGG-16 STR-14")
def duplicate_profile(spark, d):
    return profile.uniqueness(StoreViews(spark, d).blobs(), ["id", "file_hash", "pdq_hash"])


@core.add("top_resolutions", "select width, height, count(*) as n from lance_images group by 1, 2 order by n desc, width, height limit 5", "AGG-17")
def top_resolutions(spark, d):
    return profile.top_resolutions(StoreViews(spark, d).blobs())


@core.add("uri_prefix_counts", "select split_part(uri, '/', 1) as prefix, count(*) as n from lance_images where uri is not null group by 1 order by n desc, prefix limit 10", "AGG-18 STR-11")
def uri_prefix_counts(spark, d):
    return profile.top_values(StoreViews(spark, d).blobs(), F.split_part("uri", F.lit("/"), F.lit(1)), "prefix", 10)


@core.add("value_counts", "select color_mode, count(*) as n from lance_images where color_mode is not null group by 1", "AGG-18")
def value_counts(spark, d):
    return profile.top_values(StoreViews(spark, d).blobs(), F.col("color_mode"), "color_mode", None)


@core.add("invalid_images", "select count(*) as n_rows, count(*) filter (where width <= 0 or height <= 0 or file_size <= 0) as n_invalid, count(*) filter (where width is null or height is null) as n_missing from lance_images", "FLT-7 AGG-12")
def invalid_images(spark, d):
    return profile.invalid_images(StoreViews(spark, d).blobs())


@core.add("orphan_images", STORE + " select id from images where id not in (select image_id from sequence_images)", "JN-14")
def orphan_images(spark, d):
    v = StoreViews(spark, d)
    return profile.orphan_members(v.images(), v.sequence_images())


@core.add("id_reconciliation", STORE + ", a as (select distinct id from images), b as (select distinct image_id as id from sequence_images) select (select count(*) from a) as n_left, (select count(*) from b) as n_right, (select count(*) from a where id not in (select id from b)) as only_left, (select count(*) from b where id not in (select id from a)) as only_right, (select count(*) from a where id in (select id from b)) as in_both", "JN-20")
def id_reconciliation(spark, d):
    v = StoreViews(spark, d)
    return profile.reconcile(v.images(), v.sequence_images().select(F.col("image_id").alias("id")))
