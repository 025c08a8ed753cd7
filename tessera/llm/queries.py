"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialize, table
from . import ann, centroids, chat, importance, langid, linededup, mixing, packing, pieces, sharding, simhash, topk, toxicity
from .common import held_out

THRESHOLD = 0.7


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP4 = """
with t as (
  select conv_id, turn, replace(coalesce(role, ''), '<|', '< |') as speaker, replace(coalesce(text, ''), '<|', '< |') as body from conversations
), p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
r as (
  select t.conv_id, p.perspective, t.turn, t.speaker, t.body, t.speaker = p.perspective as learned,
    case when t.speaker = 'system' then 'system' when t.speaker = p.perspective then 'assistant' else 'user' end as role,
    case when t.speaker <> 'system' and t.speaker <> p.perspective then t.speaker end as name
  from t join p on t.conv_id is not distinct from p.conv_id
), s as (
  select *, '<|' || role || coalesce(' name=' || name, '') || '|>' || chr(10) as head, head || body || '<|end|>' || chr(10) as segment from r
), o as (
  select *, row_number() over w as position, sum(length(segment)) over (w rows unbounded preceding) as seg_end
  from s window w as (partition by conv_id, perspective order by turn nulls first, speaker, body)
)
select conv_id, perspective, position, turn, role, name, segment, cast(seg_end - length(segment) as bigint) as seg_start, cast(seg_end as bigint) as seg_end, learned,
  cast(case when learned then seg_end - length(segment) + length(head) end as bigint) as mask_start, cast(case when learned then seg_end - 1 end as bigint) as mask_end
from o
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded=True)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.xxhash64("starts", "ends").alias("spans_xxhash64"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x * 64).cast("double"))).alias("vec"))
    return topk.top_k(rows)


OP8 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as vec from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.vec, v.vec), lambda z: z[1] * z[2])), 0) as bigint) as score
  from v q join v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id
), r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 20
"""


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the operator reads its rows twice; pages are parsed once
    pages = materialize(table(spark, sf_dir, "pages").select("page_id", linededup.host_of(F.col("url")).alias("host"), linededup.page_text(F.col("html")).alias("text")))
    return linededup.drop_boilerplate(pages, "host", ratio=linededup.SHARE, others=False)


_BLOCKS = linededup.BLOCKS
OP9 = rf"""
with p as (
  select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)) as host,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:{_BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) as text
  from pages
), d as (select distinct host, text from p where text is not null),
l as (select host, text, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) as line from d),
t as (select host, count(*) as pages from d group by host),
g as (
  select l.host, l.line from l join t on l.host is not distinct from t.host where l.line <> '' group by l.host, l.line, t.pages
  having count(*) > 1 and count(*) > t.pages * cast({linededup.SHARE} as double)
), a as (select host, list(line) as gone from g group by host)
select p.page_id, p.host, array_to_string(list_filter(string_split(p.text, chr(10)), lambda x: not coalesce(list_contains(a.gone, trim(x)), false)), chr(10)) as text,
  cast(coalesce(len(string_split(p.text, chr(10))), 0) as bigint) as n_lines,
  cast(coalesce(len(list_filter(string_split(p.text, chr(10)), lambda x: coalesce(list_contains(a.gone, trim(x)), false))), 0) as bigint) as n_dropped
from p left join a on p.host is not distinct from a.host
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs.where(~held_out()), labels.where(~held_out()))
    out = toxicity.score(docs.select("doc_id", "text", held_out().alias("held_out")), weights).select("doc_id", "held_out", "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11 = rf"""
with byte as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{importance.UPPER}', '{importance.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), '{importance.UPPER}', '{importance.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
dw as (select rid, w, count(*) as n from (select rid, unnest(words) as w from d) group by all),
bw as (select w, count(*) as n from (select unnest(words) as w from b) group by all),
x as (select w, hex(encode(w)) as h from (select w from dw union select w from bw)),
c as (select w, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1),
  lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) % {importance.BUCKETS} as bucket from x, byte),
s as (select bucket, sum(n) as s from dw join c using (w) group by bucket), t as (select bucket, sum(n) as t from bw join c using (w) group by bucket),
a as (select cast(coalesce((select sum(s) from s), 0) as double) as ss, cast(coalesce((select sum(t) from t), 0) as double) as tt),
g as (select bucket, cast(floor(1000 * ln(((coalesce(t, 0) + cast(1 as double)) * (ss + {importance.BUCKETS})) / ((coalesce(s, 0) + cast(1 as double)) * (tt + {importance.BUCKETS})))) as bigint) as gain
  from (select distinct bucket from c) left join s using (bucket) left join t using (bucket), a),
w as (select rid, sum(n * gain) as weight from dw join c using (w) join g using (bucket) group by rid),
r as (select rid, doc_id, cast(len(words) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight, sha256('{importance.SEED}:' || coalesce(cast(doc_id as varchar), '')) as h from d left join w using (rid)),
k as (select rid, doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', h[i]) - 1), lambda p, q: p * 16 + q, cast(0 as bigint)) + 0.5) / cast(4294967296 as double)))) as bigint) as score from r),
o as (select rid, row_number() over (order by score desc, doc_id nulls last, n_features) as place, count(*) over () as n from k where n_features >= {importance.LEAST_WORDS})
select doc_id, n_features, weight, score, cast(case when place <= {importance.PERCENT} * n // 100 then place end as bigint) as rank from k left join o using (rid)
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _op12() -> str:
    """Every round assigns by a join with the centroids, then takes floored means."""
    near = "select v.rid, v.vec_id, v.vec, c.k, list_sum(list_transform(list_zip(v.vec, c.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as distance from v, {c} c qualify row_number() over (partition by v.rid order by distance, c.k) = 1"
    sql = f"""
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor({centroids.SCALE} * cast(x as double)) as bigint)) as vec from embeddings
  where len(embedding) = {centroids.DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select row_number() over (order by sha256('{centroids.SEED}:' || coalesce(cast(vec_id as varchar), '')), vec) - 1 as k, vec from v qualify k < {centroids.CLUSTERS})"""
    for i in range(centroids.ROUNDS):
        sql += f""",
n{i} as materialized ({near.format(c=f"c{i}")}),
s{i} as (select k, d, sum(x) as s, count(*) as n from (select k, unnest(vec) as x, generate_subscripts(vec, 1) as d from n{i}) group by k, d),
m{i} as (select k, list((s - ((s % n) + n) % n) // n order by d) as vec from s{i} group by k),
c{i + 1} as (select c{i}.k, list_transform(coalesce(m{i}.vec, c{i}.vec), lambda x: cast(x as bigint)) as vec from c{i} left join m{i} using (k))"""
    last = f"c{centroids.ROUNDS}"
    return sql + f""",
f as ({near.format(c=last)})
select f.vec_id, cast(f.k as integer) as cluster, cast(f.distance as bigint) as distance, cast(sum(f.distance) over (partition by f.k) as bigint) as cluster_inertia, cast(sum(f.distance) over () as bigint) as inertia,
  sha256(array_to_string({last}.vec, ',')) as centroid_sha256 from f join {last} using (k)
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ann, op2_langid, op3_simhash, op4_chat, op5_sharding, op6_packing, op7_pieces, op8_topk, op9_linededup, op10_toxicity, op11_importance, op12_centroids, op13_mixing)}
ORACLE_SQL = {"op4_chat": OP4, "op8_topk": OP8, "op9_linededup": OP9, "op11_importance": OP11, "op12_centroids": _op12()}
