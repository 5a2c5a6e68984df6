"""Queries of the evaluation pipelines: parsing, scores, similarity, retrieval, merging,
reads, streams of samples, sampling and training records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..functions.resolution import PREFERRED, fit_long_side, nearest_resolution
from ..functions.ids import canonical_id, content_id
from ..operators import reader, retrieval, sampling, scores, sequencing, store, training
from ..operators.store import StoreViews
from .core import STORE
from .registry import Registry, table

pipelines = Registry()
q = pipelines.add


def _events(spark, d):
    return table(spark, d, "events")


def _vectors(spark, d):
    return table(spark, d, "embeddings")


# -- parsing ------------------------------------------------------------------------
@q("first_sentence", "select doc_id, trim(split_part(coalesce(text, ''), '.', 1), ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) as sentence from documents", "STR-1")
def first_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.first_sentence(F.col("text")).alias("sentence"))


_RAW = "case event_id % 6 when 0 then (event_id % 14)::varchar || '@' || event_type when 1 then '```json' || chr(10) || '{\"OVERALL\": {\"score\": ' || (event_id % 11)::varchar || ', \"reason\": \"' || event_type || '\"}}' || chr(10) || '```' when 2 then '' when 3 then event_type when 4 then ' 7 @  ' || event_type || '  ' || chr(10) || 'more' else '99@' end"


def _raw(spark, d):
    e, t = F.col("event_id"), F.col("event_type")
    n = lambda k: (e % k).cast("string")
    raw = (
        F.when(e % 6 == 0, F.concat(n(14), F.lit("@"), t))
        .when(e % 6 == 1, F.concat(F.lit('```json\n{"OVERALL": {"score": '), n(11), F.lit(', "reason": "'), t, F.lit('"}}\n```')))
        .when(e % 6 == 2, F.lit(""))
        .when(e % 6 == 3, t)
        .when(e % 6 == 4, F.concat(F.lit(" 7 @  "), t, F.lit("  \nmore")))
        .otherwise(F.lit("99@"))
    )
    return _events(spark, d).select("event_id", raw.alias("raw"))


@q("parse_score_reason", f"with r as (select event_id, {_RAW} as raw from events) select event_id, case event_id % 6 when 0 then least(10, event_id % 14) when 1 then event_id % 11 when 4 then 7 end::int as score, case when event_id % 6 in (0, 1, 4) then (select event_type from events e where e.event_id = r.event_id) end as reason from r", "STR-2 STR-3")
def parse_score_reason(spark, d):
    return _raw(spark, d).select("event_id", tx.score_and_reason(F.col("raw")).alias("p")).select("event_id", "p.score", "p.reason")


@q("parse_float_score", "select event_id, case when value <> 1000 then greatest(0.0, least(10.0, round(value, 2))) end as score from events", "STR-4")
def parse_float_score(spark, d):
    raw = F.concat(F.round("value", 2).cast("decimal(18,2)").cast("string"), F.lit("@"), F.col("event_type"))
    return _events(spark, d).select("event_id", tx.float_score(raw).alias("score"))


@q("parse_labels", "select event_id, event_type as common, (event_id % 2)::int as label from events", "STR-5")
def parse_labels(spark, d):
    two_lines = F.concat(F.lit("COMMON: "), F.col("event_type"), F.lit("\nLABEL: "), (F.col("event_id") % 2).cast("string"))
    as_json = F.concat(F.lit('{"common": "'), F.col("event_type"), F.lit('", "label": '), (F.col("event_id") % 2).cast("string"), F.lit("}"))
    raw = F.when(F.col("event_id") % 3 == 0, as_json).otherwise(two_lines)
    return _events(spark, d).select("event_id", tx.label_pair(raw).alias("p")).select("event_id", "p.common", "p.label")


@q("json_extract", "select event_id, case when event_id % 4 = 3 then null else json_extract_string(props, '$.k')::bigint end as k from events", "STR-6")
def json_extract(spark, d):
    e, p = F.col("event_id"), F.col("props")
    raw = F.when(e % 4 == 0, p).when(e % 4 == 1, F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n```"))).when(e % 4 == 2, F.concat(F.lit("well, "), p, F.lit(" as asked"))).otherwise(F.lit("no { json"))
    return _events(spark, d).select("event_id", F.get_json_object(tx.extract_json(raw), "$.k").cast("bigint").alias("k"))


@q("caption_fields", "select id, coalesce(nullif(concat_ws(', ', json_extract_string(content, '$.subject'), json_extract_string(content, '$.style')), ''), content) as prompt from texts where content like '{%' and json_valid(content)", "STR-8 STR-18")
def caption_fields(spark, d):
    rows = table(spark, d, "texts").filter(F.col("content").startswith("{") & F.try_parse_json("content").isNotNull())
    c = F.col("content")
    return rows.select("id", tx.compose_prompt([F.get_json_object(c, "$.subject"), F.get_json_object(c, "$.style")], c).alias("prompt"))


#: The characters Unicode calls blank, as (?U)\s has them: DuckDB's \s is ASCII alone.
_BLANKS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@q("style_suffix", f"select id, base || case when regexp_matches(base, '[.!?]$') then ' ' else '. ' end || 'Keep the style.' as prompt from (select id, regexp_replace(content, '^{_BLANKS}|{_BLANKS}$', '', 'g') as base from texts where content is not null)", "STR-10")
def style_suffix(spark, d):
    return table(spark, d, "texts").filter("content is not null").select("id", tx.with_style(F.col("content"), "Keep the style.").alias("prompt"))


@q("path_parts", r"select id, regexp_replace(regexp_extract(uri, '([^/]*)$', 1), '\.[^.]*$', '') as stem, lower(regexp_extract(uri, '(\.[^./]+)$', 1)) as ext, split_part(uri, '/', 1) as top from lance_images where uri is not null", "STR-11")
def path_parts(spark, d):
    u = F.col("uri")
    return table(spark, d, "lance_images").filter("uri is not null").select("id", tx.path_stem(u).alias("stem"), tx.path_extension(u).alias("ext"), F.split_part(u, F.lit("/"), F.lit(1)).alias("top"))


@q("canonical_ids", "select distinct element_id, case when length(h) = 32 then h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] else lower(trim(element_id)) end as id from (select element_id, lower(regexp_replace(regexp_replace(trim(element_id), '^0[xX]', ''), '-', '', 'g')) as h from sample_annotation_elements)", "ID-1 PRJ-10")
def canonical_ids(spark, d):
    return table(spark, d, "sample_annotation_elements").select("element_id", canonical_id(F.col("element_id")).alias("id")).distinct()


@q("content_ids", "select id, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] as content_id from (select id, md5(coalesce(length(source)::varchar || ':' || source, '~') || coalesce(length(uri)::varchar || ':' || uri, '~') || coalesce(length(content)::varchar || ':' || content, '~')) as m from texts)", "ID-1 ID-2")
def content_ids(spark, d):
    return table(spark, d, "texts").select("id", content_id(F.col("source"), F.col("uri"), F.col("content")).alias("content_id"))


# -- scores -------------------------------------------------------------------------
_SCORES = "select user_id as key, event_type as metric, avg(value) as value from events group by all"


def _scores(spark, d):
    return _events(spark, d).groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))


@q("score_alignment", f"with s as ({_SCORES}) select key, max(case when metric = 'click' then value end) is not null as has_click, count(distinct metric) as n_metrics from s group by key", "JN-18")
def score_alignment(spark, d):
    metrics = ["click", "view", "purchase", "signup", "error"]
    s = _scores(spark, d)
    names = [r.metric for r in s.select("metric").distinct().orderBy("metric").collect()]
    wide = scores.align(s, names or metrics)
    have = [F.when(F.col(f"`{m}`") != "N/A", 1).otherwise(0) for m in names]
    total = have[0]
    for h in have[1:]:
        total = total + h
    click = (F.col("click") != "N/A") if "click" in names else F.lit(False)
    return wide.select("key", click.alias("has_click"), total.cast("long").alias("n_metrics"))


@q("caption_multimap", "select user_id as key, string_agg(event_type, ',' order by event_id) as captions from events group by 1", "JN-19")
def caption_multimap(spark, d):
    rows = _events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("file_no"), F.col("event_type").alias("value"))
    return scores.caption_lists(rows).select("key", F.array_join("captions", ",").alias("captions"))


@q("metric_means", "select event_type as dataset, round(avg(json_extract_string(props, '$.k')::double), 6) as mean, count(*) as n from events where json_extract_string(props, '$.k') is not null group by 1", "AGG-20 SNK-8")
def metric_means(spark, d):
    out = scores.metric_means(_events(spark, d).select(F.col("event_type").alias("dataset"), F.col("props").alias("raw")))
    return out.select("dataset", F.round("mean", 6).alias("mean"), "n")


@q("judge_means", "select user_id as key, case when count(value) >= 3 then round(avg(value), 6) end as mean, count(value) as n from events group by 1", "AGG-21 SCR-6")
def judge_means(spark, d):
    out = scores.judge_means(_events(spark, d).select(F.col("user_id").alias("key"), "value"))
    return out.select("key", F.round("mean", 6).alias("mean"), "n")


@q("common_keys", "select distinct user_id as key from events where event_type = (select min(event_type) from events) intersect select distinct user_id from events where event_type = (select max(event_type) from events)", "JN-16 JN-17")
def common_keys(spark, d):
    e = _events(spark, d)
    ends = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    side = lambda t: e.filter(F.col("event_type") == t).select(F.col("user_id").alias("key")).distinct()
    return scores.common_keys(side(ends.a), side(ends.b))


@q("key_differences", "(select user_id as key, 'first' as side from events where event_id % 2 = 0 except select user_id, 'first' from events where event_id % 2 = 1) union (select user_id, 'second' from events where event_id % 2 = 1 except select user_id, 'second' from events where event_id % 2 = 0)", "SET")
def key_differences(spark, d):
    e = _events(spark, d)
    a = e.filter("event_id % 2 = 0").select(F.col("user_id").alias("key")).distinct()
    b = e.filter("event_id % 2 = 1").select(F.col("user_id").alias("key")).distinct()
    return a.subtract(b).withColumn("side", F.lit("first")).union(b.subtract(a).withColumn("side", F.lit("second")))


@q("binary_softmax", "select event_id, round(1 / (1 + exp(least(60, greatest(-60, -(value - 50) / 10)))), 6) as p, round(1 / (1 + exp(least(60, greatest(-60, -(value - (event_id % 7)))))), 6) as s from events", "MTH-9 SCR-4")
def binary_softmax(spark, d):
    v = F.col("value")
    return _events(spark, d).select("event_id", F.round(vec.sigmoid((v - 50) / 10), 6).alias("p"), F.round(vec.binary_softmax(v, (F.col("event_id") % 7).cast("double")), 6).alias("s"))


@q("logprob_judge", "select event_id, round(1 / (1 + exp(-((-0.1 * (event_id % 9)) - (-0.2 * (event_id % 5))))), 6) as p_one, (event_id % 2)::int as predicted from events", "SCR-1 SCR-2 SCR-3 SCR-5")
def logprob_judge(spark, d):
    e = F.col("event_id")
    one, zero = (F.lit(-0.1) * (e % 9)).cast("decimal(5,2)").cast("string"), (F.lit(-0.2) * (e % 5)).cast("decimal(5,2)").cast("string")
    tops = F.concat(F.lit('[{"token": " 1", "logprob": '), one, F.lit('}, {"token": "0", "logprob": '), zero, F.lit('}, {"token": "x", "logprob": -9}]'))
    raw = F.concat(F.lit('{"choices": [{"message": {"content": " '), (e % 2).cast("string"), F.lit('."}, "logprobs": {"content": [{"token": "1", "logprob": -0.1, "top_logprobs": '), tops, F.lit("}]}}]}"))
    entries = scores.top_logprobs(raw)
    content = F.get_json_object(raw, "$.choices[0].message.content")
    return _events(spark, d).select("event_id", F.round(scores.probability_of_one(entries), 6).alias("p_one"), scores.predicted_digit(content).alias("predicted"))


@q("running_stats", "select user_id, event_id, round(median(value) over w, 9) as median, round(avg(value) over w, 9) as avg, max(value) over w as max, round(avg(value) over (partition by user_id order by event_id), 9) as global_avg from events window w as (partition by user_id order by event_id rows between 19 preceding and current row)", "AGG-25")
def running_stats(spark, d):
    out = scores.running_stats(_events(spark, d), "user_id", ["event_id"], "value")
    return out.select("user_id", "event_id", F.round("median", 9).alias("median"), F.round("avg", 9).alias("avg"), "max", F.round("global_avg", 9).alias("global_avg"))


# -- vectors ------------------------------------------------------------------------
_PAIRS = "select a.vec_id, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"


def _pairs(spark, d):
    e = _vectors(spark, d)
    return e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


@q("pair_similarity", f"with p as ({_PAIRS}) select vec_id, round(list_cosine_similarity(x, y), 6) as cosine, round(greatest(0, least(1, (list_cosine_similarity(x, y) + 1) / 2)), 6) as cosine01, round(list_dot_product(x, y), 6) as dot, round(1 / (1 + list_distance(list_transform(x, lambda v: v / greatest(1e-6, sqrt(list_dot_product(x, x)))), list_transform(y, lambda v: v / greatest(1e-6, sqrt(list_dot_product(y, y)))))), 6) as l2 from p", "MTH-2 MTH-3 MTH-8")
def pair_similarity(spark, d):
    x, y = F.col("x"), F.col("y")
    return _pairs(spark, d).select("vec_id", *[F.round(vec.similarity(x, y, k), 6).alias(k) for k in ("cosine", "cosine01", "dot", "l2")])


@q("ensemble_similarity", f"with p as ({_PAIRS}) select vec_id, round((list_cosine_similarity(x, y) + list_cosine_similarity(x[1:32], y[1:32])) / 2, 6) as ensemble from p", "MTH-4 MTH-5")
def ensemble_similarity(spark, d):
    x, y = F.col("x"), F.col("y")
    return _pairs(spark, d).select("vec_id", F.round(vec.ensemble(vec.cosine_or_zero(x, y), vec.cosine_or_zero(F.slice(x, 1, 32), F.slice(y, 1, 32))), 6).alias("ensemble"))


@q("standardised_mse", f"with p as ({_PAIRS}), m as (select *, list_avg(x) as mx, list_avg(y) as my, list_var_samp(x) as vx, list_var_samp(y) as vy from p) select vec_id, round(list_avg(list_transform(generate_series(1, len(x)), lambda i: pow((x[i] - mx) / sqrt(vx + 1e-5) - (y[i] - my) / sqrt(vy + 1e-5), 2))), 6) as cas from m", "MTH-6")
def standardised_mse(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(vec.standardised_mse(F.col("x"), F.col("y")), 6).alias("cas"))


@q("mean_pooled", "select vec_id, round((embedding[1]::double + embedding[33]::double) / 2, 6) as d1, round((embedding[32]::double + embedding[64]::double) / 2, 6) as d32, round(list_sum(embedding::double[]) / 2, 6) as total from embeddings", "MTH-7")
def mean_pooled(spark, d):
    """Each vector as two tokens of 32 dimensions, pooled."""
    tokens = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    pooled = _vectors(spark, d).select("vec_id", vec.mean_pool(tokens, 32).alias("p"))
    return pooled.select("vec_id", F.round(F.element_at("p", 1), 6).alias("d1"), F.round(F.element_at("p", 32), 6).alias("d32"), F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_RANKED = "with s as (select q.vec_id as qid, q.label as ql, g.label as gl, round(list_dot_product(q.embedding::double[], g.embedding::double[]), 9) as sim, g.vec_id as gid from embeddings q join embeddings g on g.vec_id <> q.vec_id where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by qid order by sim desc, gid) as rank, (ql = gl)::int as hit from s), h as (select *, sum(hit) over (partition by qid order by rank) as hits from r), n as (select count(*) as n from embeddings where vec_id % 100 = 0)"


def _ranked(spark, d, k):
    """Every vector whose id is divisible by 100 asks all others."""
    e = _vectors(spark, d)
    queries = e.filter("vec_id % 100 = 0")
    return retrieval.nearest(queries, e, k), queries.count()


@q("retrieval_metrics", _RANKED + ", k(k) as (values (1), (5), (100)), a as (select k, qid, max(hit) as got, min(case when hit = 1 then rank end) as first, sum(hits / rank) / k as ap from h, k where rank <= k group by k, qid) select k::int as k, round(sum(got) / max(n), 6) as recall, round(avg(1 / first), 6) as mrr, round(sum(ap) / max(n), 6) as map from a, n group by k", "WIN-3 WIN-4 WIN-5 WIN-6")
def retrieval_metrics(spark, d):
    ranked, n = _ranked(spark, d, 100)
    return retrieval.metrics_at(ranked, n, [1, 5, 100])


@q("topk_accuracy", _RANKED + " select round(100.0 * count(distinct qid) / (select n from n), 4) as accuracy from h where rank <= 5 and hit = 1", "WIN-7")
def topk_accuracy(spark, d):
    ranked, n = _ranked(spark, d, 5)
    return retrieval.topk_accuracy(ranked, n, 5)


# -- writing ------------------------------------------------------------------------
_STAGED = "select l_orderkey as k, l_linenumber as line, l_partkey as part, l_quantity as qty, l_suppkey % 4 as batch, l_orderkey * 1000003 + l_partkey * 31 + l_suppkey as ord, l_extendedprice as price from lineitem"


def _staged(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), (F.col("l_suppkey") % 4).alias("batch"), (F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 31 + F.col("l_suppkey")).alias("ord"), F.col("l_extendedprice").alias("price"))


@q("batch_dedup", f"with s as ({_STAGED}) select k, line, min(ord) as ord from s group by 1, 2", "DML-1 DML-2")
def batch_dedup(spark, d):
    return store.batch_dedup(_staged(spark, d), ["k", "line"], "ord").select("k", "line", "ord")


@q("upsert_replace", f"with s as ({_STAGED}), t as (select k, line, min(part) as part, null::bigint as batch, null::bigint as ord from s where batch = 0 group by 1, 2), a as (select * from t union all select k, line, part, batch, ord from s where batch > 0), r as (select *, row_number() over (partition by k, line order by batch desc nulls last, ord, part) as rn from a) select k, line, part from r where rn = 1", "DML-3 SNK-2")
def upsert_replace(spark, d):
    s = _staged(spark, d)
    target = s.filter("batch = 0").groupBy("k", "line").agg(F.min("part").alias("part"))
    return store.upsert_replace(target, s.filter("batch > 0"), ["k", "line"], "batch", "ord").select("k", "line", "part")


@q("merge_ignore", f"with s as ({_STAGED}), t as (select k, line, min(part) as part from s where batch = 0 group by 1, 2), n as (select k, line, part, row_number() over (partition by k, line order by batch, ord) as rn from s where batch > 0) select * from t union all select k, line, part from n where rn = 1 and not exists (select 1 from t where t.k = n.k and t.line = n.line)", "DML-4 DML-5 DML-11")
def merge_ignore(spark, d):
    s = _staged(spark, d)
    target = s.filter("batch = 0").groupBy("k", "line").agg(F.min("part").alias("part"))
    return store.merge_ignore(target, s.filter("batch > 0"), ["k", "line"], "batch", "ord")


@q("flatten_sequences", STORE + " select 'sequence_images' as table_name, count(*) as n from (select distinct sequence_id, image_id, \"index\" from sequence_images) union all select 'sequence_texts', count(*) from (select distinct sequence_id, text_id, \"index\" from sequence_texts)", "DML-10")
def flatten_sequences(spark, d):
    v = StoreViews(spark, d)
    count = lambda rows, name: rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
    return count(v.sequence_images(), "sequence_images").unionByName(count(v.sequence_texts(), "sequence_texts"))


# -- reads by selector --------------------------------------------------------------
_POS = "select *, row_number() over (order by id) - 1 as pos from lance_images"
WANTED = [4, 0, 2, 17, 2]


@q("take_by_indices", f"select id, pos from ({_POS}) where pos in (4, 0, 2, 17)", "SRC-2")
def take_by_indices(spark, d):
    rows = reader.with_positions(table(spark, d, "lance_images").select("id", "uri"), ["id"])
    return reader.take(rows, "pos", WANTED, ["id"], keep_order=True)


@q("take_by_query", "select source, id from lance_images where source in ('ferncap', 'lumen_edit')", "SRC-4 SRC-9")
def take_by_query(spark, d):
    return reader.take(table(spark, d, "lance_images"), "source", ["lumen_edit", "ferncap"], ["id"])


@q("take_by_ids", "select id, file_size from lance_images where id in (select id from lance_images order by id limit 20)", "SRC-5 SRC-6")
def take_by_ids(spark, d):
    rows = table(spark, d, "lance_images")
    ids = [r.id for r in rows.select("id").orderBy("id").limit(20).collect()]
    return reader.Reader(spark).take(reader.Ref(f"{d}/lance_images.parquet", columns=["id", "file_size"], ids=ids))


@q("multi_take", "select id, source from lance_images where source = 'ferncap' union all select id, source from texts where source = 'lumen_edit'", "SRC-7 SRC-8")
def multi_take(spark, d):
    r = reader.Reader(spark)
    return r.take_all([reader.Ref(f"{d}/lance_images.parquet", ["id", "source"], query={"source": ["ferncap"]}), reader.Ref(f"{d}/texts.parquet", ["id", "source"], query={"source": ["lumen_edit"]})])


# -- streams of samples -------------------------------------------------------------
_ISLANDS = "with m as (select *, case when lag(event_type) over (partition by user_id order by ts, event_id) is not distinct from event_type and row_number() over (partition by user_id order by ts, event_id) > 1 then 0 else 1 end as n from events), r as (select *, sum(n) over (partition by user_id order by ts, event_id) as run_no from m)"


@q("run_groups", _ISLANDS + " select user_id, run_no::bigint as run_no, min(event_type) as event_type, count(*) as n_rows from r group by 1, 2", "WIN-1")
def run_groups(spark, d):
    runs = sequencing.run_groups(_events(spark, d), "user_id", ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "run_no").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n_rows"))


@q("run_groups_capped", _ISLANDS + ", c as (select *, ((row_number() over (partition by user_id, run_no order by ts, event_id) - 1) // 2)::int as chunk_no from r) select user_id, run_no::bigint as run_no, chunk_no, count(*) as n_rows from c group by all", "WIN-1")
def run_groups_capped(spark, d):
    runs = sequencing.run_groups(_events(spark, d), "user_id", ["ts", "event_id"], "event_type", 2)
    return runs.groupBy("user_id", "run_no", "chunk_no").agg(F.count(F.lit(1)).alias("n_rows"))


@q("range_filter", "select id from lance_images where width between 512 and 1500 and height >= 512 and (clarity is null or clarity <= 400)", "FLT-9 FLT-10")
def range_filter(spark, d):
    rows = table(spark, d, "lance_images")
    rules = {"width": (512, 1500), "height": (512, None), "clarity": (None, 400.0)}
    return rows.filter(sequencing.in_range(rules, rows.columns, {"clarity"}) & sequencing.has_keys(["width", "height"], rows.columns)).select("id")


@q("route_and_union", "select event_id, case event_type when (select min(event_type) from events) then value * 2 else value end as value from events", "PRJ-8 PRJ-2")
def route_and_union(spark, d):
    e = _events(spark, d)
    first = e.agg(F.min("event_type")).first()[0]
    rows = e.select("event_id", "event_type", "value")
    return sequencing.route(rows, F.col("event_type"), {first: lambda r: r.withColumn("value", F.col("value") * 2), "__default__": lambda r: r}).select("event_id", "value")


@q("attach_side_file", "with s as (select o_custkey as key, min(o_orderkey) as o from orders group by 1 having count(*) = 1) select c_custkey as key, s.o as side_order from customer left join s on s.key = c_custkey", "SRC-13")
def attach_side_file(spark, d):
    side = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("order"))
    return sequencing.attach(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), side, "key", "side_")


@q("unique_keys", "select o_orderkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) = 1)", "SRC-17")
def unique_keys(spark, d):
    return sequencing.unique_keys(table(spark, d, "orders"), "o_custkey").select("o_orderkey")


@q("odd_keys", "select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1 having count(*) % 2 = 1", "SRC-18")
def odd_keys(spark, d):
    return sequencing.odd_keys(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@q("prefix_groups", r"with f as (select regexp_extract(regexp_replace(regexp_extract(uri, '([^/]*)$', 1), '\.[^.]*$', ''), '^(.{3}).*$', 1) as key, uri from lance_images where uri is not null) select key, count(*) as n_files from f group by 1", "AGG-27")
def prefix_groups(spark, d):
    images = table(spark, d, "lance_images").filter("uri is not null")
    stem = tx.path_stem(F.col("uri"))
    files = images.select(F.concat(F.substring(stem, 1, 3), F.lit("_"), stem, F.lit(".png")).alias("path"))
    keys = images.select(F.substring(stem, 1, 3).alias("key")).distinct().withColumn("prompt", F.lit("p"))
    return sequencing.prefix_groups(files, keys, last=False).select("key", F.size("paths").cast("long").alias("n_files"))


@q("interleaved", "select event_id, (event_id % 4)::int as stream, row_number() over (order by md5('0:' || event_id), event_id) - 1 as turn from events", "PRJ-7")
def interleaved(spark, d):
    return sequencing.interleave(_events(spark, d).select("event_id"), 4, "event_id")


@q("projected", "select id, uri from lance_images", "PRJ-1")
def projected(spark, d):
    return sequencing.keep_columns(table(spark, d, "lance_images"), ["id", "uri", "absent"])


@q("flat_mapped", "select sequence_id, unnest(list_filter(images, lambda m: m is not null)).id as image_id from sequences_data where images is not null", "PRJ-6")
def flat_mapped(spark, d):
    return table(spark, d, "sequences_data").select("sequence_id", F.explode("images").alias("m")).filter("m is not null").select("sequence_id", F.col("m.id").alias("image_id"))


# -- sampling -----------------------------------------------------------------------
@q("stable_sample", "select id from lance_images order by md5('7:' || id), id limit 50", "SMP-1 SMP-7")
def stable_sample(spark, d):
    return sampling.stable_sample(table(spark, d, "lance_images").select("id"), "id", 50, 7)


@q("stride_shards", "with r as (select doc_id, row_number() over (order by doc_id) - 1 as rn from documents) select doc_id, (rn % 3)::int as machine, ((rn // 3) % 4)::int as rank from r", "SMP-3")
def stride_shards(spark, d):
    return sampling.stride_shard(table(spark, d, "documents").select("doc_id"), "doc_id", 3, 4)


@q("chunk_assign", "with r as (select doc_id, row_number() over (order by doc_id) - 1 as rn, count(*) over () as n from documents) select doc_id, (rn // ((n + 6) // 7))::int as worker from r", "SMP-2")
def chunk_assign(spark, d):
    return sampling.chunk_assign(table(spark, d, "documents").select("doc_id"), "doc_id", 7)


@q("even_split", "with r as (select doc_id, row_number() over (order by doc_id) - 1 as rn, count(*) over () as n from documents), p as (select unnest(generate_series(0, 6)) as part) select doc_id, part::int as part from r join p on rn >= n * part // 7 and rn < n * (part + 1) // 7", "SMP-5")
def even_split(spark, d):
    return sampling.even_split(table(spark, d, "documents").select("doc_id"), "doc_id", 7)


@q("seeds", "select id, coalesce(1000 + try_cast(split_part(uri, '/', 3)[1:3] as bigint), 1000) as seed from lance_images", "SMP-6")
def seeds(spark, d):
    return table(spark, d, "lance_images").select("id", sampling.seed_for(1000, F.substring(F.split_part("uri", F.lit("/"), F.lit(3)), 1, 3)).alias("seed"))


@q("balanced_pairs", None, "SMP-4 JN-26")
def balanced_pairs(spark, d):
    docs = table(spark, d, "documents").filter("source is not null")
    contents = docs.select(F.col("source").alias("content")).distinct()
    prompts = docs.filter("kind = 'caption'").select(F.col("source").alias("content"), tx.first_sentence(F.col("text")).alias("prompt")).filter("prompt <> ''").distinct()
    styles = table(spark, d, "embeddings").select(F.concat(F.lit("style"), F.col("label").cast("string")).alias("style")).distinct()
    return sampling.balanced_pairs(contents, styles, prompts, 4, 7)


@q("nearest_resolution", "with c(w, h) as (values " + ", ".join(f"({w}, {h})" for w, h in PREFERRED) + "), g as (select id, w, h, row_number() over (partition by id order by abs(width::double / height - w::double / h), w, h) as rn from lance_images, c where width > 0 and height > 0) select id, w as target_width, h as target_height from g where rn = 1", "LIM-2 IMG-5")
def nearest(spark, d):
    rows = table(spark, d, "lance_images").filter("width > 0 and height > 0").select("id", "width", "height")
    return nearest_resolution(rows).select("id", "target_width", "target_height")


@q("fit_long_side", "select id, greatest(1, round(width * least(1.0, 1024.0::double / greatest(width, height))))::int as w, greatest(1, round(height * least(1.0, 1024.0::double / greatest(width, height))))::int as h from lance_images", "IMG-5")
def fit_side(spark, d):
    w, h = fit_long_side(F.col("width"), F.col("height"), 1024)
    return table(spark, d, "lance_images").select("id", w.alias("w"), h.alias("h"))


@q("natural_index_order", r"""with i as (select distinct m.index as idx from (select unnest(images) as m from sequences_data) where m is not null)
select idx, row_number() over (order by (idx is null or idx = '')::int, coalesce(try_cast(nullif(regexp_extract(idx, '(\d+)$', 1), '') as double), 'inf'::double), idx nulls last)::int as place from i""", "SRT-1")
def natural_index_order(spark, d):
    from pyspark.sql import Window

    idx = table(spark, d, "sequences_data").select(F.explode("images").alias("m")).filter("m is not null").select(F.col("m.index").alias("idx")).distinct()
    return idx.select("idx", F.row_number().over(Window.orderBy(*tx.natural_order(F.col("idx")))).alias("place"))


# -- training records ---------------------------------------------------------------
ROLES = ["instruction_en", "instruction_cn", "primary_description_en", "primary_description_cn"]
_TRAIN = """with latest as (
  select * from (select *, row_number() over (partition by sequence_id order by create_time desc nulls last) as rn from sequences_data) where rn = 1
)"""


@q("training_choices", _TRAIN + ", s as (select sequence_id, list_filter(images, lambda e: e is not null and e.index is not null) as im, list_filter(texts, lambda e: e is not null and e.index is not null) as tx from latest), r as (select sequence_id, im, tx, list_filter(['instruction_en', 'instruction_cn', 'primary_description_en', 'primary_description_cn'], lambda r: list_contains(list_transform(tx, lambda e: e.index), r)) as roles from s where list_contains(list_transform(im, lambda e: e.index), 'source') and list_contains(list_transform(im, lambda e: e.index), 'target')) select sequence_id, len(roles)::int as n_choices, array_to_string(roles, ',') as roles, len(list_filter(im, lambda e: e.index in ('source', 'target')))::int as n_images from r where len(roles) > 0", "STR-19 SNK-6")
def training_choices(spark, d):
    out = training.training_choices(StoreViews(spark, d).exports().select("sequence_id", "images", "texts"), ROLES)
    return out.select("sequence_id", F.size("sequence_choices").alias("n_choices"), F.array_join(F.transform("sequence_choices", lambda c: c["choice"][1]["index"]), ",").alias("roles"), F.size("images").alias("n_images"))


@q("training_validate", _TRAIN + ", i as (select sequence_id, images, texts, unnest(c.choice) as i from (select sequence_id, images, texts, unnest(sequence_choices) as c from latest)), v as (select sequence_id, count(*) as n_items, count(*) filter (where not coalesce(case i.type when 'image' then list_contains(list_transform(list_filter(images, lambda e: e is not null), lambda e: e.index), i.index) when 'text' then list_contains(list_transform(list_filter(texts, lambda e: e is not null), lambda e: e.index), i.index) end, false)) as n_unknown from i where i is not null group by 1) select l.sequence_id, coalesce(len(l.sequence_choices), 0)::int as n_choices, coalesce(v.n_items, 0)::int as n_items, coalesce(v.n_unknown, 0)::int as n_unknown from latest l left join v using (sequence_id)", "STR-20")
def training_validate(spark, d):
    return training.validate_records(StoreViews(spark, d).exports())
