"""Queries over edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from . import views as v
from .base import query

@query("select src, dst, label * 2 + src as label from main_next", "next_supp main_next")
def p1_map_edges(spark, sf):
    return g.map_edges(v.main_next(spark, sf), F.col("label") * 2 + F.col("src"))


@query("select src, dst, case when src = dst then -label else label end as label from trade_edges", "trade trade_edges")
def p2_map_self_loops(spark, sf):
    return g.map_self_loops(v.trade_edges(spark, sf), -F.col("label"))


@query("select dst as src, src as dst, label from main_next", "next_supp main_next")
def p3_transpose(spark, sf):
    return g.transpose(v.main_next(spark, sf))


@query("select src, dst, label from next_supp where label is not null and label <> 1 and src < dst", "next_supp")
def p4_filter_edges(spark, sf):
    return g.drop_null_edges(v.next_supp(spark, sf), F.lit(1)).where("src < dst")


@query("select src, dst, label from flow_edges where src = dst", "flow_edges")
def p5_self_loops(spark, sf):
    return g.self_loops(v.flow_edges(spark, sf))


@query("select 1 as part, src, dst, label from next_supp union all select 2, src, dst, label % 7 from next_supp", "next_supp")
def p6_split_labels(spark, sf):
    pairs = v.next_supp(spark, sf).withColumn("label", F.struct(F.col("label").alias("a"), (F.col("label") % 7).alias("b")))
    a, b = g.split_labels(pairs, "a", "b")
    return a.select(F.lit(1).alias("part"), "*").union(b.select(F.lit(2).alias("part"), "*"))


@query("select n.dst as src, n.src as dst, e.label from next_supp n left join main_next e on e.src = n.dst and e.dst = n.src", "next_supp main_next")
def j1_edge_lookup(spark, sf):
    return g.edge_lookup(g.transpose(v.next_supp(spark, sf)).select("src", "dst"), v.main_next(spark, sf))


@query("select 'from' as side, e.* from main_next e join top_next t on e.src = t.dst union all select 'to', e.* from main_next e join top_next t on e.dst = t.dst", "next_supp main_next top_next")
def j2_edges_from_to(spark, sf):
    e, n = v.main_next(spark, sf), v.top_next(spark, sf).select(F.col("dst").alias("id"))
    return g.edges_from(e, n).select(F.lit("from").alias("side"), "*").union(g.edges_to(e, n).select(F.lit("to").alias("side"), "*"))


@query("""select 'keep' as op, e.* from main_next e where src in (select dst from top_next) and dst in (select dst from top_next)
union all select 'remove', e.* from main_next e where src not in (select dst from top_next) and dst not in (select dst from top_next)
union all select 'edge', e.* from main_next e where not exists (select 1 from top_next t where t.src = e.src and t.dst = e.dst)""", "next_supp main_next top_next")
def j3_keep_remove(spark, sf):
    e, t = v.main_next(spark, sf), v.top_next(spark, sf)
    n = t.select(F.col("dst").alias("id"))
    tag = lambda d, x: d.select(F.lit(x).alias("op"), "src", "dst", "label")
    return tag(g.keep_nodes(e, n), "keep").union(tag(g.remove_nodes(e, n), "remove")).union(tag(g.remove_edges(e, t), "edge"))


@query("select c.src, d.dst, min(c.label + d.label) as label from trade_edges c join main_next d on c.dst = d.src group by c.src, d.dst", "trade trade_edges next_supp main_next")
def j4_compose(spark, sf):
    return g.compose(v.trade_edges(spark, sf), v.main_next(spark, sf), lambda a, b: a + b, F.min)


@query("select a.s_name as src, b.s_name as dst, label from next_supp join supplier a on a.s_suppkey = src join supplier b on b.s_suppkey = dst", "next_supp")
def j5_rename_nodes(spark, sf):
    from ..sources.tables import table

    return g.rename_nodes(v.next_supp(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("new")))


@query("""select 'succ' as side, dst as id from (select distinct src, dst from next_supp where src in (select dst from top_next where label >= (select max(label) from top_next))) group by dst
  having count(*) = (select count(distinct dst) from top_next where label >= (select max(label) from top_next))
union all select 'pred', src from (select distinct src, dst from next_supp where dst in (select dst from top_next where label >= (select max(label) from top_next))) group by src
  having count(*) = (select count(distinct dst) from top_next where label >= (select max(label) from top_next))""", "next_supp top_next")
def j8_common_neighbours(spark, sf):
    e, t = v.next_supp(spark, sf), v.top_next(spark, sf)
    s = t.join(F.broadcast(t.agg(F.max("label").alias("m"))), F.col("label") >= F.col("m")).select(F.col("dst").alias("id"))
    return g.common_successors(e, s).select(F.lit("succ").alias("side"), "id").union(g.common_predecessors(e, s).select(F.lit("pred").alias("side"), "id"))


@query("""select 'min' as side, n.src as id from (select distinct src from top_next) n where not exists (select 1 from main_next e where e.dst = n.src and e.src <> e.dst and e.label - 9 <= 0 and e.src in (select src from top_next))
union all select 'max', n.src from (select distinct src from top_next) n where not exists (select 1 from main_next e where e.src = n.src and e.src <> e.dst and e.label - 9 <= 0 and e.dst in (select src from top_next))""", "next_supp main_next top_next")
def j9_relative_extremes(spark, sf):
    e = v.main_next(spark, sf).withColumn("label", F.col("label") - 9)
    n = v.top_next(spark, sf).select(F.col("src").alias("id"))
    return g.relative_minima(e, n).select(F.lit("min").alias("side"), "id").union(g.relative_maxima(e, n).select(F.lit("max").alias("side"), "id"))


@query("select m.src, m.dst, m.label, t.label as other from main_next m left join next_supp t on t.src = m.dst and t.dst = m.src where not (m.src = m.dst) and (t.label is null or t.label > m.label)", "next_supp main_next")
def j10_implication(spark, sf):
    return g.implication_violators(v.main_next(spark, sf), g.transpose(v.next_supp(spark, sf)), F.col("src") == F.col("dst"))


@query("select src, dst, arg_max(label, seq) as label from trade group by src, dst", "trade")
def a1_build_last_wins(spark, sf):
    return g.build_last(v.trade(spark, sf), "seq")


@query("select src, dst, max(label) as label from trade group by src, dst", "trade")
def a2_build_with(spark, sf):
    return g.build_with(v.trade(spark, sf), F.max)


@query("select src, dst, list_reduce(list(label order by label), lambda acc, x: (acc * 31 + x) % 1000003) as label from (select distinct s.s_nationkey as src, n.r_regionkey as dst, s.s_suppkey as label from supplier s join nation m on s.s_nationkey = m.n_nationkey join region n on n.r_regionkey = m.n_regionkey) group by src, dst")
def a2_build_fold(spark, sf):
    from ..sources.tables import table

    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.col("s_suppkey").alias("label"))
    return g.build_fold(rows, "label", lambda new, old: (old * 31 + new) % 1000003)


@query("""select id, bool_or(s) as is_source, bool_or(t) as is_target, not bool_or(s) and not bool_or(t) as is_isolated from (
select src as id, true as s, false as t from top_next union all select dst, false, true from top_next union all select s_suppkey + 1, false, false from supplier) group by id""", "next_supp top_next")
def a3_node_sets(spark, sf):
    from ..sources.tables import table

    return g.node_sets(v.top_next(spark, sf), table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("id")))


@query("select src, count(*) as degree, string_agg(dst || ':' || label, ',' order by dst) as neighbours from trade_edges group by src", "trade trade_edges")
def a4_adjacency(spark, sf):
    a = g.adjacency(v.trade_edges(spark, sf))
    return a.select("src", "degree", F.array_join(F.transform(F.array_sort(F.map_entries("neighbours")), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string"))), ",").alias("neighbours"))


@query("""select id, coalesce(list_sort(list_distinct(list(low) filter (low is not null))), []) as lower_bounds, coalesce(list_sort(list_distinct(list(up) filter (up is not null))), []) as upper_bounds, bool_or(f) as must_be_finite from (
select dst as id, src as low, null as up, false as f from main_next union all select src, null, case when dst <> 0 then dst end, dst = 0 and label - 9 < 0 from main_next) where id in (select src from top_next) group by id""", "next_supp main_next top_next")
def a16_bounds(spark, sf):
    e = v.main_next(spark, sf).withColumn("label", F.col("label") - 9)
    return g.bounds(e, v.top_next(spark, sf).select(F.col("src").alias("id")), F.lit(0))


@query("select coalesce(a.src, b.src) as src, coalesce(a.dst, b.dst) as dst, coalesce(a.label, b.label) as label from trade_edges a full join main_next b on a.src = b.src and a.dst = b.dst", "trade trade_edges next_supp main_next")
def u1_union_left(spark, sf):
    return g.union_left(v.trade_edges(spark, sf), v.main_next(spark, sf))


@query("select src, dst, cast(sum(label) as bigint) as label from (select * from trade_edges union all select * from main_next) group by src, dst", "trade trade_edges next_supp main_next")
def u2_union_with(spark, sf):
    return g.union_with(F.sum, v.trade_edges(spark, sf), v.main_next(spark, sf))


@query("select id, row_number() over (order by id) - 1 as node_id from (select src as id from next_supp union select dst from next_supp)", "next_supp")
def w11_dense_ids(spark, sf):
    e = v.next_supp(spark, sf)
    return g.dense_ids(e.select(F.col("src").alias("id")).union(e.select("dst")), "id")


@query("""select src, dst, min(label) as label from (select * from main_next union all select -1, id, 0 from n union all select id, id, 0 from n union all select id, -2, 0 from n) group by src, dst""".replace("select src, dst, min", ", n as (select src as id from main_next union select dst from main_next) select src, dst, min", 1), "next_supp main_next")
def g16_reflexive_closure(spark, sf):
    e = v.main_next(spark, sf)
    return g.reflexive_closure(e, e.select(F.col("src").alias("id")).union(e.select("dst")), F.lit(-1), F.lit(-2), F.lit(0))
