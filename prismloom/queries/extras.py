"""Queries of writes, bindings, text clean-up, hashes and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.bits import hamming_bits
from ..operators import annotations as ann
from ..operators import scores, sequencing, store, training, views
from ..operators.store import StoreViews
from ..plans.storage import Workspace
from ..sources import files, tar
from .core import STORE
from .registry import Registry, table

extras = Registry()
q = extras.add


@q("sql_scan", "select id, source, width from lance_images where source = 'ferncap' and width >= 1024", "SRC-1")
def sql_scan(spark, d):
    rows = table(spark, d, "lance_images")
    return spark.sql("select id, source, width from {rows} where source = :source and width >= :least", args={"source": "ferncap", "least": 1024}, rows=rows)


@q("bound_texts", "select 'texts' as table_name, count(distinct id) as n from texts union all select 'sequence_texts', count(distinct (source, id)) from texts where source is not null", "DML-7 DML-10")
def bound_texts(spark, d):
    items = table(spark, d, "texts").select("id", "content", F.col("source").alias("sequence_id"), F.when(F.col("source").isNotNull(), F.lit("index_0")).alias("index"))
    every, bridge = store.bind_items(items, "text")
    count = lambda rows, name: rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
    return count(every, "texts").unionByName(count(bridge, "sequence_texts"))


@q("bound_labels", STORE + " select 'annotations' as table_name, count(distinct id) as n from labels union all select 'image_annotations', count(distinct id) from labels where type = 'image' and creator_id is not null union all select 'text_annotations', count(distinct id) from labels where type = 'text' and creator_id is not null", "DML-9 DML-13")
def bound_labels(spark, d):
    labels = StoreViews(spark, d).annotations().withColumn("element_id", F.col("creator_id"))
    every, images, texts = store.bind_annotations(labels)
    count = lambda rows, name: rows.agg(F.lit(name).alias("table_name"), F.count_distinct(rows.columns[-1] if "annotation_id" in rows.columns else "id").alias("n"))
    return count(every, "annotations").unionByName(count(images, "image_annotations")).unionByName(count(texts, "text_annotations"))


@q("annotation_rows", "select event_type as name, count(distinct (user_id % 25, event_id % 100)) as n, count(distinct user_id % 25) as n_creators from events group by 1", "DML-8 ID-1")
def annotation_rows(spark, d):
    e = table(spark, d, "events")
    who = F.array(F.struct((F.col("event_id") % 100).cast("string").alias("element_id"), F.lit("image").alias("element_type"), F.lit("target").alias("role")))
    rows = e.select(F.col("event_type").alias("name"), (F.col("user_id") % 25).cast("string").alias("creator_name"), F.lit(None).cast("string").alias("creator_meta"), F.col("user_id").cast("string").alias("sequence_id"), F.col("value").cast("string").alias("value"), who.alias("participants"))
    made = store.sample_annotation_rows(rows)["sample_annotations"]
    return made.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("creator_id").alias("n_creators"))


@q("split_values", "select id, case when isfinite(try_cast(value_json as double)) then try_cast(value_json as double) when trim(value_json) = 'true' then 1.0 when trim(value_json) = 'false' then 0.0 end::float::double as number, case when not coalesce(isfinite(try_cast(value_json as double)), false) and trim(value_json) not in ('true', 'false') then value_json end as text from (select distinct id, value_json from sample_annotations where value_json is not null)", "DML-8")
def split_values(spark, d):
    rows = table(spark, d, "sample_annotations").filter("value_json is not null").select("id", "value_json").distinct()
    number, text = store.split_value(F.col("value_json"))
    return rows.select("id", number.cast("double").alias("number"), text.alias("text"))


@q("gallery_pairs", "with u as (select uri, max(id) as id from lance_images where uri is not null group by 1) select distinct im.source as sequence_id, u.id as image_id, 'gallery' as idx from lance_images im join u on u.uri = im.uri where im.source is not null", "JN-22")
def gallery_pairs(spark, d):
    images = table(spark, d, "lance_images")
    sequences = images.filter("source is not null").select(F.col("source").alias("sequence_id")).distinct()
    members = images.select(F.col("source").alias("sequence_id"), "uri", F.lit("gallery").alias("index"))
    return views.gallery_pairs(sequences, members, images).withColumnRenamed("index", "idx")


@q("prompt_lists", "select event_id, case event_id % 3 when 0 then 'a|' || event_type when 1 then 'first|' || event_type end as prompts from events", "STR-9")
def prompt_lists(spark, d):
    e, t = F.col("event_id"), F.col("event_type")
    raw = F.when(e % 3 == 0, F.concat(F.lit('["a", " ", "'), t, F.lit('"]'))).when(e % 3 == 1, F.concat(F.lit('{"2": "'), t, F.lit('", "1": "first"}'))).otherwise(F.lit("none"))
    return table(spark, d, "events").select("event_id", F.array_join(tx.pick_prompts(raw), "|").alias("prompts"))


@q("linked_images", "select event_id, 'http://h/' || event_type || '.png|https://h/b.jpg' as urls from events", "STR-22")
def linked_images(spark, d):
    raw = F.concat(F.lit("see ![x](http://h/"), F.col("event_type"), F.lit(".png) and https://h/b.jpg or http://h/"), F.col("event_type"), F.lit(".png"))
    return table(spark, d, "events").select("event_id", F.array_join(tx.image_urls(raw), "|").alias("urls"))


@q("clean_captions", "select event_id, 'A painting of ' || event_type || ', bright' as caption from events", "STR-23")
def clean_captions(spark, d):
    raw = F.concat(F.lit('"A watercolor painting of '), F.col("event_type"), F.lit(' ,bright"'))
    return table(spark, d, "events").select("event_id", tx.clean_caption(raw).alias("caption"))


@q("asked_pixels", "select event_id, case when event_id % 2 = 0 then (event_id + 1000)::int end as pixels from events", "STR-13")
def asked_pixels(spark, d):
    e = F.col("event_id")
    message = F.when(e % 2 == 0, F.concat(F.lit("error: image size must be at least about "), (e + 1000).cast("string"), F.lit(" pixels"))).otherwise(F.lit("fine"))
    return table(spark, d, "events").select("event_id", tx.minimum_pixels(message).alias("pixels"))


@q("language_captions", "select id, case when regexp_replace(regexp_extract(uri, '([^/]*)$', 1), '\\.[^.]*$', '') like '%cn%' then 'cn' else 'en' end as language from texts where uri is not null", "JN-6 STR-11")
def language_captions(spark, d):
    rows = table(spark, d, "texts").filter("uri is not null")
    return rows.select("id", views.caption_for_language(tx.path_stem(F.col("uri")), F.lit("cn"), F.lit("en")).alias("language"))


@q("target_captions", "select id, coalesce(nullif(trim(case when ltrim(content) like '{%' and json_valid(content) then json_extract_string(content, '$.caption') when ltrim(content) not like '{%' then content end, ' '), ''), nullif(trim(uri, ' '), '')) as caption from texts where content is not null", "STR-18")
def target_captions(spark, d):
    rows = table(spark, d, "texts").filter("content is not null")
    return rows.select("id", training.target_caption(F.col("content"), F.col("uri")).alias("caption"))


@q("hash_distance", "with p as (select id, pdq_hash, lead(pdq_hash) over (partition by source order by id) as other from lance_images) select id, bit_count(xor(pdq_hash::bit, other::bit))::int as bits from p where pdq_hash is not null and other is not null", "IMG-4")
def hash_distance(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "lance_images").select("id", "source", "pdq_hash").withColumn("other", F.lead("pdq_hash").over(Window.partitionBy("source").orderBy("id")))
    return rows.filter("pdq_hash is not null and other is not null").select("id", hamming_bits(F.col("pdq_hash"), F.col("other"), 32).alias("bits"))


@q("path_ids", "select distinct vault_path as path, sha256(vault_path) as path_id from sequences_data where vault_path is not null", "ID-2")
def path_ids(spark, d):
    return table(spark, d, "sequences_data").filter("vault_path is not null").select("vault_path", F.sha2("vault_path", 256).alias("path_id")).withColumnRenamed("vault_path", "path").distinct()


@q("label_confidence", "select event_id, round(case event_id % 3 when 0 then 1 / (1 + exp(-(-0.25 + 1.5))) when 1 then exp(-0.25) else 1 - exp(-0.5) end, 6) as p_one from events", "SCR-5")
def label_confidence(spark, d):
    both = '[{"token": "1", "logprob": -0.25}, {"token": " 0", "logprob": -1.5}]'
    one, zero = '[{"token": "1 ", "logprob": -0.25}]', '[{"token": "0", "logprob": -0.5}]'
    e = F.col("event_id")
    raw = F.concat(F.lit('{"top_logprobs": '), F.when(e % 3 == 0, both).when(e % 3 == 1, one).otherwise(zero), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.round(scores.probability_of_one(scores.top_logprobs(raw)), 6).alias("p_one"))


@q("directory_prompts", "select p.p_partkey as key, p.p_name as prompt from part p where p.p_partkey in (select l_partkey from lineitem) and p.p_partkey % 10 <> 0", "JN-17")
def directory_prompts(spark, d):
    have = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    prompts = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 10 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("prompt"))
    return scores.common_keys(have, prompts).filter(F.length(tx.strip(F.col("prompt"))) > 0)


@q("image_annotations_of", STORE + " select el.element_id, sa.id, sa.name from el join sa on sa.id = el.sample_annotation_id where el.element_type = 'image' and el.element_id in (select id from images)", "JN-11")
def image_annotations_of(spark, d):
    v = StoreViews(spark, d)
    on = v.elements().filter("element_type = 'image'").join(v.images().select(F.col("id").alias("element_id")), "element_id", "left_semi")
    return on.select("element_id", F.col("sample_annotation_id").alias("id")).join(v.sample_annotations().select("id", "name"), "id").select("element_id", "id", "name")


@q("export_round_trip", STORE + " select sa.id, sa.name, sa.sequence_id, c.name as creator_name from sa join creators c on c.id = sa.creator_id", "SNK-1 SNK-5 SNK-9")
def export_round_trip(spark, d):
    """Annotations with their elements written as CSV, JSONL and Parquet one after the other; the
    annotations of what comes back are returned."""
    v = StoreViews(spark, d)
    rows = ann.export(v.sample_annotations(), v.creators(), v.elements(), "left").filter("creator_name is not null")
    space = Workspace(spark, "export")
    for fmt in ("csv", "jsonl", "parquet"):
        path = space.fresh(fmt)
        files.write_rows(rows, path, fmt)
        rows = files.read_rows(spark, path, fmt, rows.schema)
    # an annotation's copies are what each of its elements has
    of_element = rows.groupBy(*rows.columns).count()
    copies = of_element.groupBy("id", "name", "sequence_id", "value_float", "value_json", "creator_name").agg(F.max("count").alias("n"))
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("id", "name", "sequence_id", "creator_name")


@q("staged_append", "select id, source from lance_images where id is not null", "SNK-2 SNK-3")
def staged_append(spark, d):
    """Two staged halves published in one job, then read again."""
    space = Workspace(spark, "commit")
    rows = table(spark, d, "lance_images").select("id", "source")
    stages = [space.fresh("stage") for _ in range(2)]
    for i, path in enumerate(stages):
        rows.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == i).write.parquet(path)
    target = space.fresh("dataset")
    files.staged_commit(spark, stages, target, "overwrite")
    return spark.read.parquet(target)


@q("resumed", "select o_orderkey as key from orders where o_orderkey not in (select l_orderkey from lineitem)", "SNK-7 STM-2")
def resumed(spark, d):
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return scores.remaining(tasks, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))).select("key")


@q("tar_round_trip", "select id || '.txt' as fname, octet_length(encode(content)) as size from texts where content is not null", "SRC-10 SRC-11 SRC-14 SNK-4")
def tar_round_trip(spark, d):
    """The captions of every language, and of none, written as tar shards and scanned again."""
    folder = Workspace(spark, "tar").fresh("shards")
    rows = table(spark, d, "texts").filter("content is not null").select(F.col("id").alias("key"), F.encode(F.lit("image"), "utf-8").alias("image"), F.col("content").alias("caption"))
    tar.write_tar(rows, folder).write.format("noop").mode("overwrite").save()
    return tar.member_index(tar.read_tar(spark, folder)).filter(F.col("fname").endswith(".txt")).select("fname", "size")


@q("unique_side", "select p_partkey as key, (select count(*) from lineitem l where l.l_partkey = p.p_partkey) = 1 as single from part p", "SRC-13 SRC-17")
def unique_side(spark, d):
    side = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.lit(True).alias("single"))
    return sequencing.attach(table(spark, d, "part").select(F.col("p_partkey").alias("key")), side).select("key", F.coalesce("single", F.lit(False)).alias("single"))
