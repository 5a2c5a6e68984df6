"""Queries of the language-model problems (3, 4, 5, 7, 8 and 9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..queries.registry import Registry, table
from . import copies, cutoffs, dedup, mixing, packing, pii

llm = Registry()


_DUPLICATES = """
with recursive i as (
  select id, coalesce(batch_id, -2147483649) as b, min(file_hash) as f, min(case when octet_length(pdq_hash) = 32 then pdq_hash end)::bit as h from lance_images group by 1, 2
), pairs as (
  select x.id as x, y.id as y from i x join i y on x.f = y.f where (x.b, x.id) < (y.b, y.id)
  union
  select x.id, y.id from i x join i y on (x.b, x.id) < (y.b, y.id) and bit_count(xor(x.h, y.h)) <= 31
), r(n, id, st) as (
  select 0, id, 'open' from (select x as id from pairs union select y from pairs)
  union all
  select p.n + 1, p.id, case when p.st <> 'open' then p.st when e.hit then 'duplicate' when not coalesce(e.live, false) then 'accepted' else 'open' end
  from (select *, count(*) filter (where st = 'open') over () as n_open from r) p
    left join (select y as id, bool_or(st = 'accepted') as hit, bool_or(st <> 'duplicate') as live from pairs join r on r.id = pairs.x group by 1) e on e.id = p.id
  where p.n_open > 0
)
select id from r where st = 'duplicate' and n = (select max(n) from r)"""


@llm.add("p3_found", _DUPLICATES, "P3")
def p3_found(spark, sf_dir):
    return dedup.ingest_history(spark, table(spark, sf_dir, "lance_images"))


_SCORES = """
with n as (select source, count(*) as n from lance_images group by source),
s as (
  select source, 'clarity' as score_name, id, clarity as score from lance_images
  union all select source, 'pdq_quality', id, pdq_quality from lance_images
), r as (
  select s.*, t.keep_percent, n.n, (n.n * t.keep_percent + 99) // 100 as k,
    row_number() over (partition by s.source, s.score_name order by score desc) as rn,
    count(*) over (partition by s.source, s.score_name) as have
  from s join source_targets t on t.source = s.source and t.score_name = s.score_name join n on n.source = s.source
  where score is not null and not isnan(score)
), c as (select source, score_name, min(score) as cutoff from r where rn = least(k, have) group by all)
"""


@llm.add("p4_found", _SCORES + "select r.source, r.score_name, r.id from r join c on c.source = r.source and c.score_name = r.score_name where r.score >= c.cutoff", "P4")
def p4_found(spark, sf_dir):
    return cutoffs.ShareCutoffs(spark, table(spark, sf_dir, "lance_images"), table(spark, sf_dir, "source_targets")).kept()


@llm.add(
    "p4_cutoffs",
    _SCORES
    + """
select t.source, t.score_name, t.keep_percent, coalesce(n.n, 0) as n, coalesce((n.n * t.keep_percent + 99) // 100, 0)::bigint as wanted,
  c.cutoff::double as cutoff, (select count(*) from r where r.source = t.source and r.score_name = t.score_name and r.score >= c.cutoff) as kept
from source_targets t left join n on n.source = t.source left join c on c.source = t.source and c.score_name = t.score_name""",
    "P4",
)
def p4_cutoffs(spark, sf_dir):
    return cutoffs.ShareCutoffs(spark, table(spark, sf_dir, "lance_images"), table(spark, sf_dir, "source_targets")).report()


def _records(spark, sf_dir):
    texts = copies.text_keys(table(spark, sf_dir, "texts"))
    return texts.unionByName(copies.manifest_keys(table(spark, sf_dir, "image_manifests")))


def _half_year():
    return 2 * F.year("at") + (F.quarter("at") > 2).cast("int")


_MANIFESTS = r"""
with m as (
  select manifest_id, record, lower(regexp_replace(regexp_replace(trim(json_extract_string(record, '$.file_hash')), '^0[xX]', ''), '[^0-9a-fA-F]', '', 'g')) as h,
    json_extract_string(record, '$.uri') as uri, lower(json_extract_string(record, '$.color_mode')) as mode,
    try_cast(json_extract_string(record, '$.width') as double) as w, try_cast(json_extract_string(record, '$.height') as double) as ht,
    try_cast(json_extract_string(record, '$.file_size') as double) as fs, try_cast(json_extract_string(record, '$.batch') as double) as b
  from image_manifests where record is not null
), g as (select *, min(manifest_id) over (partition by h, uri, mode, w, ht, fs, b) as kept_id, count(*) over (partition by h, uri, mode, w, ht, fs, b) as n from m)
"""


_WIDE, _PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


_PATH = r".\[\]"


def _plain_sql(col: str, keep: str = "") -> str:
    return rf"regexp_replace(lower(upper(translate({col}, '{_WIDE}', '{_PLAIN}'))), '[^\p{{L}}\p{{N}}{keep}]', '', 'g')"


_COPIES = (
    _MANIFESTS.rstrip()
    + rf"""
, t as (
  select id, content, content like '%{{%' and json_valid(content) and coalesce(try(json_type(content)) = 'OBJECT', false) as is_object from texts where content is not null
), leaf as (
  select t.id, string_agg({_plain_sql('e.fullkey', keep=_PATH)} || ':' || case when e.type in ('OBJECT', 'ARRAY') then e.type || '()' else coalesce({_plain_sql("(e.atom ->> '$')")}, 'null') end, ';' order by {_plain_sql('e.fullkey', keep=_PATH)}, {_plain_sql("(e.atom ->> '$')")}) as form
  from t, json_tree(t.content) e where t.is_object group by t.id
), k as (
  select t.id, case when t.is_object then 'J' || l.form else 'P' || {_plain_sql('t.content')} end as k from t left join leaf l on l.id = t.id
), c as (select id, min(id) over (partition by k) as kept_id from k)
select 'text' as record_type, kept_id, id as copy_id from c where id <> kept_id
union all select 'manifest', kept_id, manifest_id from g where manifest_id <> kept_id"""
)


@llm.add("p5_found", _COPIES, "P5")
def p5_found(spark, sf_dir):
    return copies.find_copies(spark, _records(spark, sf_dir), _half_year())[1]


@llm.add("p5_manifest_copies", _MANIFESTS + "select kept_id, n as copies from g where manifest_id = kept_id and n > 1", "P5")
def p5_manifest_copies(spark, sf_dir):
    ledger, _ = copies.find_copies(spark, copies.manifest_keys(table(spark, sf_dir, "image_manifests")), _half_year())
    return ledger.read().filter("n > 1").select("kept_id", F.col("n").alias("copies"))


@llm.add("p7_pack_2048", covers="P7")
def p7_pack_2048(spark, sf_dir):
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), 2048)


@llm.add("p7_pack_512", covers="P7")
def p7_pack_512(spark, sf_dir):
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), 512)


@llm.add("p7_pack_4096", covers="P7")
def p7_pack_4096(spark, sf_dir):
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), 4096)


@llm.add("p7_fill", covers="P7")
def p7_fill(spark, sf_dir):
    """How full the rows of each capacity are, and that none is at fault."""
    sizes = packing.sizes_of(spark, table(spark, sf_dir, "documents"))
    parts = [packing.fill_report(packing.pack(spark, sizes, c), c).select(F.lit(c).alias("capacity"), "*") for c in (512, 2048, 4096)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@llm.add("p8_mix", covers="P8")
def p8_mix(spark, sf_dir):
    return mixing.SourceMix(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).chosen()


@llm.add("p8_shares", covers="P8")
def p8_shares(spark, sf_dir):
    return mixing.SourceMix(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report()


@llm.add("p9_found", covers="P9")
def p9_found(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


@llm.add("p9_redacted", covers="P9")
def p9_redacted(spark, sf_dir):
    return pii.redact_documents(table(spark, sf_dir, "documents")).select("doc_id", "redacted")
