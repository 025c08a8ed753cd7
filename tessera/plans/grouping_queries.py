"""Queries of multisets, duplicates, dominance and order-based windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping as g
from ..sources.tables import table
from . import views as v
from .base import query


def _lines(spark, sf):
    return v.doc_lines(spark, sf)


# -- filters and partitions -----------------------------------------------------------------------


@query("""select o_orderkey, case when o_totalprice > 300000 then 'large' when o_totalprice < 50000 then 'small' else '' end as class from orders""")
def p7_partition_by_class(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    cls = F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_totalprice") < 50000, "small")
    return g.classed(o, cls, ["large", "small"]).select("o_orderkey", "class")


@query("select o_orderkey, o_custkey in (select c_custkey from customer where c_acctbal < 0) as is_in from orders")
def p8_partition_keys(spark, sf):
    keys = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    inside, outside = g.partition_keys(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", keys)
    return inside.select("o_orderkey", F.lit(True).alias("is_in")).union(outside.select("o_orderkey", F.lit(False).alias("is_in")))


@query("select p_partkey, p_name from part where contains(p_name, 'r') and contains(p_name, 'ing') and list_has_any(string_split(p_name, ' ') || [p_type], ['small', 'red']) and list_has_any(string_split(p_name, ' ') || [p_type], ['ECONOMY', 'PROMO'])")
def p9_find_mentions(spark, sf):
    p = table(spark, sf, "part")
    return g.find_mentions(p, F.col("p_name"), F.concat(F.split("p_name", " "), F.array("p_type")), ["r", "ing"], [["small", "red"], ["ECONOMY", "PROMO"]]).select("p_partkey", "p_name")


@query("select o_orderkey, o_custkey from orders o where o_orderpriority <> '5-LOW' or not exists (select 1 from orders p where p.o_custkey = o.o_custkey and p.o_orderpriority <> '5-LOW')")
def p10_drop_if_accompanied(spark, sf):
    return g.drop_if_accompanied(table(spark, sf, "orders"), "o_custkey", F.col("o_orderpriority") == "5-LOW").select("o_orderkey", "o_custkey")


# -- multisets ------------------------------------------------------------------------------------


@query("select line, count(*) as n from doc_lines group by line", "doc_lines")
def a5_counts(spark, sf):
    return g.counts(_lines(spark, sf), "line")


@query("select length(line) as value, count(*) as n from (select line from doc_lines union all select p_name from part) group by length(line)", "doc_lines")
def a6_bag_union_map(spark, sf):
    a = g.counts(_lines(spark, sf).withColumnRenamed("line", "value"), "value")
    b = g.counts(table(spark, sf, "part").select(F.col("p_name").alias("value")), "value")
    return g.bag_map(g.bag_union(a, b), F.length("value").cast("long"))


@query("select line from doc_lines group by line having count(*) > 1", "doc_lines")
def a7_duplicated(spark, sf):
    return g.duplicated(_lines(spark, sf), "line")


@query("select doc_id, seq, line from (select *, row_number() over (partition by line order by doc_id, seq) as k from doc_lines) where k > 1", "doc_lines")
def a8_later_copies(spark, sf):
    d = _lines(spark, sf).withColumn("_at", F.struct("doc_id", "seq"))
    return g.later_copies(d, "line", "_at").drop("_at")


@query("select 'doc_id' as name, count(*) = count(distinct doc_id) as is_key, count(distinct doc_id) <= 1 as is_constant from documents union all select 'lang', count(*) = count(distinct lang), count(distinct lang) <= 1 from documents")
def a9_key_checks(spark, sf):
    d = table(spark, sf, "documents")
    return g.key_checks(d, "doc_id").select(F.lit("doc_id").alias("name"), "*").union(g.key_checks(d, "lang").select(F.lit("lang").alias("name"), "*"))


@query("select o_custkey, string_agg(o_orderpriority, ',' order by o_orderkey) as members from orders group by o_custkey")
def a10_group_by_key(spark, sf):
    return g.group_by_key(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderpriority").withColumn("members", F.array_join("members", ","))


@query("select line, doc_id, count(*) over (partition by line) as n from doc_lines", "doc_lines")
def a11_unique_or_ambiguous(spark, sf):
    return g.unique_or_ambiguous(_lines(spark, sf), "line", "doc_id")


# -- dominance ------------------------------------------------------------------------------------


@query("select p_partkey, p_size, p_retailprice from part a where not exists (select 1 from part b where b.p_size <= a.p_size and b.p_retailprice <= a.p_retailprice and (b.p_size < a.p_size or b.p_retailprice < a.p_retailprice or b.p_partkey < a.p_partkey))")
def a18_skyline(spark, sf):
    return g.skyline(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "p_partkey")


NEW, OLD = "(select * from part where p_brand = 'Brand#1')", "(select * from part where p_brand = 'Brand#2')"


@query(f"""select 'new' as side, p_partkey from {NEW} n where not exists (select 1 from {OLD} o where o.p_size <= n.p_size and o.p_retailprice <= n.p_retailprice)
union all select 'old', p_partkey from {OLD} o where not exists (select 1 from {NEW} n where n.p_size <= o.p_size and n.p_retailprice <= o.p_retailprice and (n.p_size <> o.p_size or n.p_retailprice <> o.p_retailprice))""")
def a19_compare_skylines(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    new, old = g.compare_skylines(p.where("p_brand = 'Brand#1'"), p.where("p_brand = 'Brand#2'"), ["p_size", "p_retailprice"])
    return new.select(F.lit("new").alias("side"), "p_partkey").union(old.select(F.lit("old").alias("side"), "p_partkey"))


@query("""select a.n_nationkey as a, b.n_nationkey as b,
case when a.n_nationkey = b.n_nationkey and a.n_regionkey = b.n_regionkey then 'EQ' when a.n_nationkey < b.n_nationkey and a.n_regionkey < b.n_regionkey then 'LT' when a.n_nationkey > b.n_nationkey and a.n_regionkey > b.n_regionkey then 'GT'
  when a.n_nationkey <= b.n_nationkey and a.n_regionkey <= b.n_regionkey then 'LE' when a.n_nationkey >= b.n_nationkey and a.n_regionkey >= b.n_regionkey then 'GE' else 'Any' end as pointwise,
case when a.n_nationkey = b.n_nationkey then 'EQ' when list_has_all([b.n_nationkey % 3, b.n_regionkey], [a.n_nationkey % 3, a.n_regionkey]) and list_has_all([a.n_nationkey % 3, a.n_regionkey], [b.n_nationkey % 3, b.n_regionkey]) then 'EQ'
  when list_has_all([b.n_nationkey % 3, b.n_regionkey], [a.n_nationkey % 3, a.n_regionkey]) then 'LT' when list_has_all([a.n_nationkey % 3, a.n_regionkey], [b.n_nationkey % 3, b.n_regionkey]) then 'GT' else 'Any' end as inclusion
from nation a, nation b""")
def a20_dominance_orders(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.array("n_nationkey", "n_regionkey").alias("p"), F.array(F.col("n_nationkey") % 3, "n_regionkey").alias("s"))
    pairs = n.alias("a").crossJoin(n.alias("b"))
    return pairs.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), g.pointwise(F.col("a.p"), F.col("b.p")).alias("pointwise"), g.inclusion(F.col("a.s"), F.col("b.s")).alias("inclusion"))


# -- order ----------------------------------------------------------------------------------------

ORDERS = "(select o_orderkey, o_custkey, o_orderpriority, o_totalprice from orders)"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


@query(f"select * from {ORDERS} qualify row_number() over (partition by o_custkey order by o_orderkey) = 1")
def w1_first_per_key(spark, sf):
    return g.first_per_key(_orders(spark, sf), "o_custkey", "o_orderkey")


@query(f"select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) = 1 as is_first from {ORDERS}")
def w2_first_and_later(spark, sf):
    d = _orders(spark, sf).withColumn("_k", F.struct("o_custkey", "o_orderpriority"))
    return g.first_and_later(d, "_k", "o_orderkey").drop("_k")


@query(f"select o_orderpriority, o_orderkey, row_number() over (order by o_orderpriority) as position from (select * from {ORDERS} qualify row_number() over (partition by o_orderpriority order by o_orderkey) = 1)")
def w3_first_in_key_order(spark, sf):
    from ..operators.graph import dense_ids

    first = g.first_per_key(_orders(spark, sf), "o_orderpriority", "o_orderkey")
    return first.join(dense_ids(first, "o_orderpriority", "i"), "o_orderpriority").select("o_orderpriority", "o_orderkey", (F.col("i") + 1).alias("position"))


@query(f"select * from {ORDERS} qualify row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) = 1")
def w4_favourite_per_key(spark, sf):
    return g.favourite_per_key(_orders(spark, sf), "o_custkey", "o_totalprice", "o_orderkey")


@query(f"select o_custkey, coalesce(bool_and(p <= o_totalprice) filter (p is not null), true) as holds from (select *, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as p from {ORDERS}) group by o_custkey")
def w5_consecutive_check(spark, sf):
    return g.consecutive_check(_orders(spark, sf), "o_custkey", "o_orderkey", lambda prev: prev["o_totalprice"] <= F.col("o_totalprice"))


@query(f"select * exclude (n), sum(n) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as run from (select *, case when lag(o_totalprice) over (partition by o_custkey order by o_orderkey) <= o_totalprice then 0 else 1 end as n from {ORDERS})")
def w6_runs(spark, sf):
    return g.runs(_orders(spark, sf), "o_custkey", "o_orderkey", lambda prev: prev["o_totalprice"] <= F.col("o_totalprice"))


@query("""select user_id, event_type, run, count(*) as n from (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from (
  select *, case when lag(event_type) over (partition by user_id order by ts, event_id) = event_type then 0 else 1 end as n from events)) group by user_id, event_type, run""")
def w7_runs_by_tag(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return g.runs(e, "user_id", "at", lambda prev: prev["event_type"] == F.col("event_type")).groupBy("user_id", "event_type", "run").agg(F.count("*").alias("n"))


@query(f"select *, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 4 as chunk from {ORDERS}")
def w8_chunks(spark, sf):
    return g.chunks(_orders(spark, sf), "o_custkey", "o_orderkey", 4)


@query("""select event_id, user_id, event_type = 'signup' as is_separator, coalesce(sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as segment from events""")
def w9_split_when(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return g.split_when(e, "user_id", "at", F.col("event_type") == "signup").select("event_id", "user_id", "is_separator", "segment")


@query("""select stream, account, cast(sum(ms) as bigint) as ms from (select stream, account, epoch_us(lead(ts) over (partition by stream order by ts, account nulls first)) // 1000 - epoch_us(ts) // 1000 as ms from switches)
where account is not null and ms is not null group by stream, account""", "switches")
def w10_switch_bills(spark, sf):
    return g.bill_switches(v.switches(spark, sf), "stream", "ts", "account")


@query(f"select o_custkey, arg_min(o_orderkey, o_orderkey) as o_orderkey, arg_min(o_totalprice, o_orderkey) as o_totalprice from {ORDERS} where o_totalprice > 200000 group by o_custkey")
def w15_find_first(spark, sf):
    return g.find_first(_orders(spark, sf), "o_custkey", "o_orderkey", F.col("o_totalprice") > 200000).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""select o_orderkey, bool_and(o_totalprice > 60000) over (w rows between unbounded preceding and current row) as in_prefix, bool_and(o_totalprice > 60000) over (w rows between current row and unbounded following) as in_suffix,
count(*) over (w rows between current row and unbounded following) as from_end from {ORDERS} window w as (partition by o_custkey order by o_orderkey)""")
def w16_prefix_suffix_runs(spark, sf):
    return g.prefix_and_suffix_runs(_orders(spark, sf), "o_custkey", "o_orderkey", F.col("o_totalprice") > 60000).select("o_orderkey", "in_prefix", "in_suffix", "from_end")


@query("""select coalesce(a.o_custkey, b.o_custkey) as o_custkey, coalesce(a.pos, b.pos) as pos, a.o_orderkey as left, b.o_orderkey as right from
(select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as pos from orders where o_orderstatus = 'O') a full join
(select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as pos from orders where o_orderstatus = 'F') b on a.o_custkey = b.o_custkey and a.pos = b.pos""".replace("as left", 'as "left"').replace("as right", 'as "right"'))
def j11_align(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("value"), "o_orderstatus")
    return g.align_groups(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "o_custkey", "seq")


# -- set cells ------------------------------------------------------------------------------------

SETS = """(select s_suppkey, list_distinct([s_suppkey % 7, s_nationkey % 7, s_suppkey % 5]) as a, list_distinct([s_nationkey % 5, s_suppkey % 3, 6]) as b from supplier)"""


def _sets(spark, sf):
    s = table(spark, sf, "supplier")
    long = lambda c: c.cast("long")
    return s.select("s_suppkey", F.array_distinct(F.array(long(F.col("s_suppkey") % 7), long(F.col("s_nationkey") % 7), long(F.col("s_suppkey") % 5))).alias("a"), F.array_distinct(F.array(long(F.col("s_nationkey") % 5), long(F.col("s_suppkey") % 3), F.lit(6).cast("long"))).alias("b"))


def _text(c):
    return F.array_join(F.array_sort(c).cast("array<string>"), ",")


@query(f"""select s_suppkey, array_to_string(list_sort(list_distinct(a || b)), ',') as u, array_to_string(list_sort(list_intersect(a, b)), ',') as i, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as d,
array_to_string(list_sort(list_filter(range(7), lambda x: not list_contains(a, x))), ',') as c, list_has_all(b, a) as subset, not list_has_any(a, b) as disjoint, len(a) as n, list_min(a) as low, list_max(a) as high from {SETS}""")
def u6_set_columns(spark, sf):
    a, b = F.col("a"), F.col("b")
    every = F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))
    return _sets(spark, sf).select("s_suppkey", _text(F.array_union(a, b)).alias("u"), _text(F.array_intersect(a, b)).alias("i"), _text(F.array_except(a, b)).alias("d"), _text(F.array_except(every, a)).alias("c"), (F.size(F.array_except(a, b)) == 0).alias("subset"), (~F.arrays_overlap(a, b)).alias("disjoint"), F.size(a).cast("long").alias("n"), F.array_min(a).alias("low"), F.array_max(a).alias("high"))


@query(f"""select s_suppkey, array_to_string(list_sort(list_filter(a, lambda x: x < 3)), ',') as lt, array_to_string(list_sort(list_filter(a, lambda x: x <= 3)), ',') as le, array_to_string(list_sort(list_filter(a, lambda x: x > 3)), ',') as gt, array_to_string(list_sort(list_filter(a, lambda x: x >= 3)), ',') as ge from {SETS}""")
def u7_set_range_filters(spark, sf):
    f = lambda p: _text(F.filter("a", p))
    return _sets(spark, sf).select("s_suppkey", f(lambda x: x < 3).alias("lt"), f(lambda x: x <= 3).alias("le"), f(lambda x: x > 3).alias("gt"), f(lambda x: x >= 3).alias("ge"))
