"""Queries over intervals and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as i
from ..sources.tables import table
from . import views as v
from .base import query

UC = "order_spans urgent calm"
DAYS = """, ua as (select distinct grp, unnest(range(start, "end")) as d from urgent), ca as (select distinct grp, unnest(range(start, "end")) as d from calm)"""
#: Days of a table x(grp, d) as maximal runs.
RUNS = """ select grp, min(d) as start, max(d) + 1 as "end" from (select grp, d, d - row_number() over (partition by grp order by d) as k from {x}) group by grp, k"""


@query('select a.grp, a.start, a."end", a.seq, a.value, b.start as b_start, b."end" as b_end, b.seq as b_seq, b.value as b_value from urgent a join calm b on a.grp = b.grp and a.start < b."end" and b.start < a."end"', UC)
def j6_overlap_join(spark, sf):
    return i.overlap_join(v.urgent(spark, sf), v.calm(spark, sf), 365)


@query('select distinct a.grp from urgent a join calm b on a.grp = b.grp and a.start < b."end" and b.start < a."end"', UC)
def j7_overlap_exists(spark, sf):
    return i.overlap_exists(v.urgent(spark, sf), v.calm(spark, sf))


@query(DAYS + ", x as (select * from ua except select * from ca)" + RUNS.format(x="x"), UC)
def u3_subtract(spark, sf):
    return i.subtract(v.urgent(spark, sf), v.calm(spark, sf))


@query(DAYS + RUNS.format(x="ua"), UC)
def u4_fuse(spark, sf):
    return i.fuse(v.urgent(spark, sf).select("grp", "start", "end"))


@query(""", u as (select grp, min(start) as s, max("end") as e from urgent group by grp), c as (select grp, max(start) as s from calm group by grp)
select u.grp, cast(null as bigint) as start, case when c.s is not null then null else null end as "end" from u join c on u.grp = c.grp where c.s <= u.e
union all select u.grp, null, u.e from u left join c on u.grp = c.grp where c.s is null or c.s > u.e
union all select c.grp, c.s, null from c left join u on u.grp = c.grp where u.e is null or c.s > u.e""".replace("case when c.s is not null then null else null end", "cast(null as bigint)"), UC)
def u5_unbounded_union(spark, sf):
    """All days up to a customer's last urgent order, and all from the start of the last calm one on."""
    null = F.lit(None).cast("long")
    a = v.urgent(spark, sf).groupBy("grp").agg(F.max("end").alias("end")).select("grp", null.alias("start"), "end")
    b = v.calm(spark, sf).groupBy("grp").agg(F.max("start").alias("start")).select("grp", "start", null.alias("end"))
    return i.unbounded_union(a, b)


@query(""", u as (select grp, max("end") as e from urgent group by grp), c as (select grp, max(start) as s from calm group by grp)
select u.grp, cast(null as bigint) as start, case when c.s is null then u.e else least(u.e, c.s) end as "end" from u left join c on u.grp = c.grp""", UC)
def u5_unbounded_difference(spark, sf):
    null = F.lit(None).cast("long")
    a = v.urgent(spark, sf).groupBy("grp").agg(F.max("end").alias("end")).select("grp", null.alias("start"), "end")
    b = v.calm(spark, sf).groupBy("grp").agg(F.max("start").alias("start")).select("grp", "start", null.alias("end"))
    return i.unbounded_difference(a, b)


@query(""", c as (select grp, max(start) as s from calm group by grp) select u.grp, u.start as pos from urgent u join c on u.grp = c.grp where u.start >= c.s""", UC)
def u5_unbounded_member(spark, sf):
    b = v.calm(spark, sf).groupBy("grp").agg(F.max("start").alias("start")).select("grp", "start", F.lit(None).cast("long").alias("end"))
    return i.unbounded_member(v.urgent(spark, sf).select("grp", F.col("start").alias("pos")), b)


@query(""", cut as (select grp, start as t from order_spans union select grp, "end" from order_spans), seg as (select grp, t as start, lead(t) over (partition by grp order by t) as "end" from cut)
select s.grp, s.start, s."end", string_agg(o.value, '|' order by o.seq desc) as labels from seg s join order_spans o on o.grp = s.grp and o.start < s."end" and s.start < o."end" where s."end" is not null group by s.grp, s.start, s."end" """, "order_spans")
def r1_overlay(spark, sf):
    return i.overlay(v.order_spans(spark, sf)).withColumn("labels", F.array_join("labels", "|"))


@query('select grp, tag, k, unnest(range(start, "end")) as pos from doc_spans', "words doc_spans")
def r2_expand(spark, sf):
    return i.expand(v.doc_spans(spark, sf))


@query(""", x as (select grp, k as d, tag as value from doc_spans)
select grp, min(d) as start, max(d) + 1 as "end", value from (select *, d - row_number() over (partition by grp, value order by d) as r from x) group by grp, value, r""", "words doc_spans")
def r3_coalesce(spark, sf):
    return i.coalesce_positions(v.doc_spans(spark, sf).select("grp", F.col("k").alias("pos"), F.col("tag").alias("value")))


@query('select grp, value, count(*) as n, cast(sum(pos) as bigint) as total, min(pos) as low, max(pos) as high from (select grp, value, unnest(range(start, "end")) as pos from order_spans) group by grp, value', "order_spans")
def r2_expand_days(spark, sf):
    """Every day of every order, told by counts and sums."""
    return i.expand(v.order_spans(spark, sf)).groupBy("grp", "value").agg(F.count("*").alias("n"), F.sum("pos").alias("total"), F.min("pos").alias("low"), F.max("pos").alias("high"))


@query(""", x as (select distinct grp, value, unnest(range(start, "end")) as d from order_spans)
select grp, min(d) as start, max(d) + 1 as "end", value from (select *, d - row_number() over (partition by grp, value order by d) as r from x) group by grp, value, r""", "order_spans")
def r3_coalesce_days(spark, sf):
    """Long ranges, very many positions: each day of each order, coalesced by customer and priority. Spans are fused, no row is made for a day."""
    return i.coalesce_ranges(v.order_spans(spark, sf))


@query('select grp, min(start) as start, max("end") as "end" from order_spans group by grp', "order_spans")
def r4_covering(spark, sf):
    return i.covering_range(v.order_spans(spark, sf))


@query("""select grp, seq, value, 'before' as side, start, least("end", 10000) as "end" from order_spans where start < 10000 union all select grp, seq, value, 'after', greatest(start, 10000), "end" from order_spans where "end" > 10000""", "order_spans")
def r5_split_at(spark, sf):
    return i.split_at(v.order_spans(spark, sf), F.lit(10000))


@query("""select grp, seq, value, true as inside, greatest(start, 9500) as start, least("end", 10000) as "end" from order_spans where start < 10000 and "end" > 9500
union all select grp, seq, value, false, start, least("end", 9500) from order_spans where start < 9500 union all select grp, seq, value, false, greatest(start, 10000), "end" from order_spans where "end" > 10000""", "order_spans")
def r6_inside_outside(spark, sf):
    return i.inside_and_outside(v.order_spans(spark, sf), F.lit(9500), F.lit(10000))


@query(""", x as (select *, case when lag("end" // 30) over w = start // 30 then 0 else 1 end as n from order_spans window w as (partition by grp order by start, "end", seq)),
y as (select *, sum(n) over (partition by grp order by start, "end", seq rows unbounded preceding) as run from x)
select grp, min(start) as start, max("end") as "end", min(start // 30) as line_start, max("end" // 30) as line_end from y group by grp, run""", "order_spans")
def r7_fuse_per_line(spark, sf):
    """Months of 30 days stand for lines."""
    d = v.order_spans(spark, sf).select("grp", "start", "end", F.expr("start div 30").alias("line_start"), F.expr("`end` div 30").alias("line_end"))
    return i.fuse_per_line(d)


@query("""select grp, start, "end", case when n < "end" then 'overlap' else 'touch' end as problem from (select *, lead(start) over (partition by grp order by start, "end") as n from order_spans) where n <= "end" """, "order_spans")
def r8_violations(spark, sf):
    return i.violations(v.order_spans(spark, sf))


PAYLOAD = """, p as (select grp, k as seq, case when tag <> 'stop' then tag end as aspect, [tag, cast(k % 3 as varchar)] as others, case when k % 2 = 0 then tag end as note, tag = 'upper' as flag from doc_spans)"""


@query(PAYLOAD + """ select grp, arg_min(aspect, seq) filter (aspect is not null) as aspect, array_to_string(list_sort(list_distinct(flatten(list(others)))), ',') as others,
  (select string_agg(note, chr(10) || '----' || chr(10) order by s) from (select note, min(q.seq) as s from p q where q.grp = p.grp and note is not null group by note)) as note, bool_or(flag) as flag from p group by grp""", "words doc_spans")
def r9_merge_payloads(spark, sf):
    s = v.doc_spans(spark, sf)
    rows = s.select("grp", F.col("k").alias("seq"), F.when(F.col("tag") != "stop", F.col("tag")).alias("aspect"), F.array("tag", (F.col("k") % 3).cast("string")).alias("others"), F.when(F.col("k") % 2 == 0, F.col("tag")).alias("note"), (F.col("tag") == "upper").alias("flag"), F.lit(None).cast("long").alias("site"))
    return i.merge_payloads(rows, ["grp"]).select("grp", "aspect", F.array_join("others", ",").alias("others"), "note", "flag")


@query(""", g as (select doc_id as grp, text, length(text) + 1 as stop from documents where length(text) > 0), s as (select grp, start, "end", tag from doc_spans),
gaps as (select g.grp, coalesce(s."end", 1) as start, coalesce(lead(s.start) over (partition by g.grp order by s.start nulls first), g.stop) as "end", null as tag from g join (select * from s union all select grp, null, null, null from g) s on s.grp = g.grp)
select x.grp, x.start as pos, substring(g.text, cast(x.start as integer), cast(x."end" - x.start as integer)) as token, x.tag from (select * from s union all select * from gaps where start < "end") x join g on g.grp = x.grp""", "words doc_spans")
def r10_token_stream(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("grp"), "text")
    return i.token_stream(docs, v.doc_spans(spark, sf).select("grp", "start", "end", "tag"))


@query("""select o_orderkey as id, case when p_partkey is null then null else replace(p_name, ' ', '%20') || case when p_partkey - 5 > 1 then '#' || (p_partkey - 5) else '' end end as href from orders left join part on p_partkey = o_orderkey""")
def r11_link_target(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("site"))
    defs = table(spark, sf, "part").select(F.col("p_partkey").alias("site"), F.col("p_name").alias("file"), (F.col("p_partkey") - 5).alias("pos"))
    return i.link_target(rows, defs).drop("site")


@query(""", b as (select grp, start, "end", 0 as side from urgent union all select grp, start, "end", 1 from calm), n as (select *, row_number() over (partition by grp order by start, "end", side) as k from b),
x as (select n.*, (select min(m.k) from n m where m.grp = n.grp and m.k > n.k and m.side <> n.side) as ok from n)
select x.grp, x.side, x.start, x."end", m.start as other_start, m."end" as other_end from x join n m on m.grp = x.grp and m.k = x.ok where m.start < x."end" and x.start < m."end" """, UC)
def s4_ordered_conflicts(spark, sf):
    return i.ordered_conflicts(v.urgent(spark, sf), v.calm(spark, sf))
