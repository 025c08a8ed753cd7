"""Queries over path tables, bills, counters and sparse matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semiring import BOOLEAN, COUNTING
from ..operators import grouping, hierarchy as h, matrix as m, profile
from ..sources.tables import materialize, table
from . import views as v
from .base import query


def _p(c="path"):
    return F.array_join(c, "/")


PRE = "generate_subscripts([0] || path, 1) - 1 as n"
NODES = ", e as (select path, value, unnest(range(len(path) + 1)) as n from {t}), x as (select path[1:n] as node, path, value from e)"


@query("select array_to_string(path[1:n], '/') as path, value from (select path, value, unnest(range(len(path) + 1)) as n from path_values)", "path_values")
def h1_every_prefix(spark, sf):
    return h.every_prefix(v.path_values(spark, sf)).select(_p().alias("path"), "value")


TOTALS = NODES.format(t="path_values") + ", s as (select node as path, cast(sum(value) as bigint) as value from x where len(node) < 3 group by node)"


def _totals(spark, sf):
    return h.rollup_sums(v.path_values(spark, sf)).where(F.size("path") < 3).select("path", F.col("total").alias("value"))


@query(TOTALS + " select array_to_string(p.path, '/') as key, string_agg(s.value, ',' order by len(s.path)) as values from path_values p join s on p.path[1:len(s.path)] = s.path group by p.path".replace("as values", 'as "values"'), "path_values")
def h2_values_along(spark, sf):
    probes = v.path_values(spark, sf).select(F.col("path").alias("key"))
    return h.values_along(materialize(_totals(spark, sf)), probes).select(_p("key").alias("key"), F.array_join(F.col("values").cast("array<string>"), ",").alias("values"))


@query("select array_to_string(path[2:], '/') as path, value from path_values where path[1] = 'ASIA' union all select array_to_string(['world', 'all'] || path, '/'), value from path_values", "path_values")
def h3_subtree_and_prefix(spark, sf):
    p = v.path_values(spark, sf)
    return h.subtree(p, ["ASIA"]).select(_p().alias("path"), "value").union(h.prefix_by(p, ["world", "all"]).select(_p().alias("path"), "value"))


@query("select array_to_string(q.path, '/') as path, t.value from (select ['Brand#' || r_regionkey, 'red', 'ring', 'ECONOMY'] as path from region union all select path from type_paths where value > 40) q left join type_paths t on t.path = q.path", "type_paths")
def h4_lookup(spark, sf):
    t = v.type_paths(spark, sf)
    probe = table(spark, sf, "region").select(F.array(F.concat(F.lit("Brand#"), F.col("r_regionkey").cast("string")), F.lit("red"), F.lit("ring"), F.lit("ECONOMY")).alias("path"))
    return probe.union(t.where("value > 40").select("path")).join(t, "path", "left").select(_p().alias("path"), "value")


#: Compressed nodes of t: root, valued, leaves and branchings.
COMPRESSED = """, n as (select distinct path[1:k] as path from (select path, unnest(range(len(path) + 1)) as k from {t})),
c as (select path[1:len(path) - 1] as path, count(*) as kids from n where len(path) > 0 group by 1),
a as (select n.path, coalesce(c.kids, 0) as kids, n.path in (select path from {t}) as valued from n left join c on c.path = n.path),
k as (select * from a where len(path) = 0 or valued or kids <> 1),
z as (select k.path, k.valued, k.kids, count(*) - 1 as depth, string_agg(len(j.path), ',' order by len(j.path)) as cuts from k join k j on k.path[1:len(j.path)] = j.path group by k.path, k.valued, k.kids)"""


@query(COMPRESSED.format(t="type_paths") + " select array_to_string(path, '/') as path, valued, depth, cuts from z", "type_paths")
def h5_compress(spark, sf):
    c = h.compress(v.type_paths(spark, sf))
    sizes = F.transform(F.sequence(F.lit(0), F.size("segments")), lambda i: F.aggregate(F.slice("segments", 1, i), F.lit(0), lambda acc, s: acc + F.size(s)).cast("string"))
    assert c.columns == ["path", "segments", "valued"]
    return h.uncompress(c).select(_p().alias("path"), "valued", F.size("segments").cast("long").alias("depth"), F.array_join(sizes, ",").alias("cuts"))


@query(COMPRESSED.format(t="type_paths") + " select count(*) filter (valued) as size, count(*) filter (valued or kids = 0) as size_with_leaves from a", "type_paths")
def h6_sizes(spark, sf):
    return h.sizes(v.type_paths(spark, sf))


@query("""select array_to_string(p.path, '/') as key, coalesce(n.value, r.value, -1) as value from path_values p
left join (select path[1:2] as path, cast(sum(value) as bigint) as value from path_values group by 1 having sum(value) % 2 = 0) n on n.path = p.path[1:2]
left join (select path[1:1] as path, cast(sum(value) as bigint) as value from path_values group by 1 having sum(value) % 2 = 0) r on r.path = p.path[1:1]""", "path_values")
def h7_deepest_setting(spark, sf):
    settings = materialize(_totals(spark, sf).where("value % 2 = 0 and size(path) > 0"))
    return h.deepest_setting(settings, v.path_values(spark, sf).select(F.col("path").alias("key")), F.lit(-1).cast("long")).select(_p("key").alias("key"), "value")


SUB = ", t as (select path[2:] as path, value from type_paths where path[1] = 'Brand#1')"


@query(SUB + COMPRESSED.format(t="t") + """, w as (select depth, count(*) as n, count(*) filter (kids = 0) as leaves from z group by depth),
q as (select depth, coalesce(sum(n) over (order by depth rows between unbounded preceding and 1 preceding), 0) + leaves as nodes from w), b as (select max(depth) as d from q where nodes < 60)
select array_to_string(path, '/') as completion, 0 as shared from z, b where len(path) > 0 and (depth < b.d or (depth = b.d and kids = 0))""", "type_paths")
def h8_complete(spark, sf):
    return h.complete(v.type_paths(spark, sf), ["Brand#1"], 60).select(_p("completion").alias("completion"), F.size("extension").alias("shared"))


@query(COMPRESSED.format(t="type_paths") + " select array_to_string(path, '/') as path, depth, valued, kids = 0 as leaf from z where depth < 2 or (depth = 2 and kids = 0)", "type_paths")
def s3_truncate_depth(spark, sf):
    return h.truncate_depth(v.type_paths(spark, sf), 2).select(_p().alias("path"), F.col("depth").cast("long").alias("depth"), "valued", "leaf")


@query(COMPRESSED.format(t="type_paths") + """, w as (select depth, count(*) as n, count(*) filter (kids = 0) as leaves from z group by depth)
select depth, cast(coalesce(sum(n) over (order by depth rows between unbounded preceding and 1 preceding), 0) + leaves as bigint) as nodes from w""", "type_paths")
def s3_cut_sizes(spark, sf):
    return h.cut_sizes(v.type_paths(spark, sf)).select(F.col("depth").cast("long").alias("depth"), "nodes")


@query("""select array_to_string(path, '/') as path, cast(sum(value) as bigint) as value from (select path[1:2] as path, value from path_values where path <> ['ASIA', 'NATION_2', 'x'] union all select path[1:2], -1 from path_values) group by path""", "path_values")
def u8_trie_union(spark, sf):
    p = v.path_values(spark, sf)
    cut = h.delete(p.withColumn("path", F.slice("path", 1, 2)), ["no", "such"])
    return h.union_with(F.sum, cut, h.adjust(cut.withColumn("value", F.lit(-1).cast("long")), ["neither"], F.lit(5))).select(_p().alias("path"), "value")


def _bills(spark, sf):
    b = grouping.bill_switches(v.switches(spark, sf), "stream", "ts", "account").groupBy("account").agg(F.sum("ms").alias("ms"))
    return b.select(F.split("account", r"\.").alias("path"), F.col("ms").alias("value"))


@query("select account, ms from bills", "switches bills")
def a13_bills(spark, sf):
    return _bills(spark, sf).select(F.array_join("path", ".").alias("account"), F.col("value").alias("ms"))


ROLL = ", b as (select string_split(account, '.') as path, ms as value from bills)" + NODES.format(t="b") + ", r as (select node as path, cast(max(value) filter (node = path) as bigint) as own, cast(sum(value) as bigint) as total from x group by node)"


@query(ROLL + " select array_to_string(path, '.') as account, own, total from r", "switches bills")
def a14_path_rollup(spark, sf):
    return h.rollup_sums(_bills(spark, sf)).select(F.array_join("path", ".").alias("account"), "own", "total")


ORDER = """, o as (select r.path, r.own, r.total, list({'v': -coalesce(p.total, 0), 'k': p.path[-1]} order by len(p.path)) filter (len(p.path) > 0) as k from r join r p on r.path[1:len(p.path)] = p.path group by r.path, r.own, r.total)"""


@query(ROLL + ORDER + " select array_to_string(path, '.') as account, row_number() over (order by coalesce(k, [])) as position from o", "switches bills")
def s1_preorder(spark, sf):
    r = materialize(h.rollup_sums(_bills(spark, sf)).select("path", F.col("total").alias("value")))
    return h.preorder(r).select(F.array_join("path", ".").alias("account"), "position")


@query(ROLL + ORDER + """, body as (select row_number() over (order by coalesce(k, [])) as position, case when len(path) = 0 then 'Miscellaneous' else array_to_string(path, '.') end as account, coalesce(own, 0) as own,
  case when len(path) > 0 and coalesce(own, 0) <> total then total end as aggregate from o where total > 10)
select * from body union all select 0, 'Total', cast(coalesce(sum(own), 0) as bigint), null from body""", "switches bills")
def a15_profile_report(spark, sf):
    """A15 over W10, A13, A14 and S1: the flagship."""
    return profile.profile_report(materialize(_bills(spark, sf)))


@query("select kind, name, case when kind = 'max' then max(n) else cast(sum(n) as bigint) end as value from ticks group by kind, name", "ticks")
def a12_counters(spark, sf):
    return profile.counters(v.ticks(spark, sf))


# -- matrices -------------------------------------------------------------------------------------

DIM = 64


@query("select i, string_agg(j || ':' || v, ',' order by j) as cells from coo group by i", "coo")
def m1_sparse_rows(spark, sf):
    return m.to_sparse_rows(v.coo(spark, sf)).select("i", F.array_join(F.transform(F.array_sort(F.map_entries("cells")), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string"))), ",").alias("cells"))


@query("select i, string_agg(coalesce(v, 0), ',' order by j) as cells from (select i, unnest(range(1, 65)) as j from (select distinct i from coo)) left join coo using (i, j) group by i", "coo")
def m1_dense_rows(spark, sf):
    return m.to_dense_rows(v.coo(spark, sf), DIM, F.lit(0).cast("long")).withColumn("cells", F.array_join(F.col("cells").cast("array<string>"), ","))


@query("select vec_id + 1 as i, j, x as v from (select vec_id, unnest(list_transform(embedding, lambda x: cast(round(cast(x as double) * 4) as bigint))) as x, generate_subscripts(embedding, 1) as j from embeddings) where x <> 0")
def m1_from_lists(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") + 1).alias("i"), F.transform("embedding", lambda x: F.round(x.cast("double") * 4).cast("long")).alias("r"))
    return m.from_lists(e, "i", "r")


@query("select j as i, i as j, v from coo union all select d.i, 0, coalesce(c.v, 0) from (select unnest(range(1, 65)) as i) d left join coo c on c.i = d.i and c.j = d.i", "coo")
def m2_transpose_diagonal(spark, sf):
    c = v.coo(spark, sf)
    return m.transpose(c).union(m.diagonal(c, (10**9, DIM), F.lit(0).cast("long")).select("i", F.lit(0).cast("long"), "v"))


@query("select i, j, v // 30 as v from coo where v > 0 and v // 30 <> 0 union all select i, j, case when i = j then v * 2 else v end from coo", "coo")
def m3_map_non_zeros(spark, sf):
    c = v.coo(spark, sf)
    return m.map_non_zeros(c.where("v > 0"), lambda x: F.floor(x / 30)).union(m.map_diagonal(c, lambda x: x * 2))


@query("select i, j, cast(sum(v) as bigint) as v from (select * from coo union all select j, i, -v from coo) group by i, j having sum(v) <> 0", "coo")
def m4_add(spark, sf):
    c = v.coo(spark, sf)
    return m.add(c, m.map_non_zeros(m.transpose(c), lambda x: -x))


@query("select a.i, a.j, a.v - b.v as v from coo a join coo b on a.i = b.j and a.j = b.i", "coo")
def m5_intersect(spark, sf):
    c = v.coo(spark, sf)
    return m.intersect_with(c, m.transpose(c), lambda a, b: a - b)


@query("select a.j as i, b.j, cast(sum(a.v * b.v) as bigint) as v from coo a join coo b on a.i = b.i group by a.j, b.j having sum(a.v * b.v) <> 0", "coo")
def m6_multiply(spark, sf):
    c = v.coo(spark, sf)
    return m.multiply(m.transpose(c), c, COUNTING, F.lit(0))


@query("select a.j as i, b.j, cast(sum(a.v * b.v) as bigint) as v from coo_all a join coo_all b on a.i = b.i group by a.j, b.j having sum(a.v * b.v) <> 0", "coo_all")
def m6_multiply_blocked(spark, sf):
    """Products of all columns of the embeddings, every component in hundredths: dense blocks."""
    c = materialize(v.coo_all(spark, sf))
    return m.multiply_blocked(m.transpose(c), c)


@query("select distinct a.src as i, b.dst as j, true as v from flow_edges a join flow_edges b on a.dst = b.src", "flow_edges")
def m6_multiply_boolean(spark, sf):
    f = v.flow_edges(spark, sf).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(True).alias("v"))
    return m.multiply(f, f, BOOLEAN, F.lit(False))


@query("""select 'self' as pair, 'EQ' as result union all select 'sizes', 'Any' union all
select 'less', case when min(c) = 0 and max(c) = 0 then 'EQ' when min(c) = -1 and max(c) = -1 then 'LT' when min(c) = 1 and max(c) = 1 then 'GT' when max(c) <= 0 then 'LE' when min(c) >= 0 then 'GE' else 'Any' end from (
  select case when a.v is null then -1 when b.v is null then 1 when a.v < b.v then -1 when a.v > b.v then 1 else 0 end as c from (select * from coo where v > 0) a full join (select i, j, v + 1 as v from coo where v > 0) b on a.i = b.i and a.j = b.j)""", "coo")
def m7_compare(spark, sf):
    c, s = v.coo(spark, sf), (10**9, DIM)
    pos = c.where("v > 0")
    tag = lambda d, n: d.select(F.lit(n).alias("pair"), "result")
    return tag(m.compare(c, c, s, s), "self").union(tag(m.compare(c, c, s, (1, 1)), "sizes")).union(tag(m.compare(pos, m.map_non_zeros(pos, lambda x: x + 1), s, s), "less"))
