"""Queries of the iterative graph operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semiring import BOOLEAN, MAX_MIN, MIN_PLUS, POLARITY
from ..operators import paths as p
from ..sources.tables import materialize, table
from . import views as v
from .base import query

REACH = ", r(src, dst) as (select src, dst from {e} union select r.src, e.dst from r join {e} e on r.dst = e.src)"
START = "(select min(src) from top_next)"


def _start(e: DataFrame) -> DataFrame:
    return e.agg(F.min("src").alias("id"))


@query(f", b(id, hops) as (select {START}, 0 union select e.dst, b.hops + 1 from b join main_next e on e.src = b.id where b.hops < 60) select id, min(hops) as hops from b group by id", "next_supp main_next top_next")
def g1_reachable(spark, sf):
    e = materialize(v.main_next(spark, sf))
    return p.reachable(e, _start(e))


@query(f", b(id, path) as (select {START}, [{START}] union all select e.dst, b.path || [e.dst] from b join top_next e on e.src = b.id where not list_contains(b.path, e.dst)) select id, len(path) - 1 as hops, path from b", "next_supp top_next")
def g2_shortest_paths(spark, sf):
    e = materialize(v.top_next(spark, sf))
    return p.shortest_paths(e, _start(e))


def _walk(e: DataFrame) -> DataFrame:
    ends = e.agg(F.min("src").alias("a"), F.max("dst").alias("b")).first()  # two node numbers
    heavy = e.agg(F.max("label")).first()[0]
    return p.walk_satisfying(e, F.col("label") >= 1, F.col("label") == heavy, F.lit(ends["a"]), F.lit(ends["b"]))


@query(""", t(id, hops) as (select min(src), 0 from main_next union select e.dst, t.hops + 1 from t join main_next e on e.src = t.id where t.hops < 40),
t1 as (select id, min(hops) as h from t group by id),
u(id, hops) as (select max(dst), 0 from main_next union select e.src, u.hops + 1 from u join main_next e on e.dst = u.id where u.hops < 40),
u1 as (select id, min(hops) as h from u group by id)
select * from (select min(t1.h + 1 + u1.h) as length from main_next e join t1 on t1.id = e.src join u1 on u1.id = e.dst where e.label = (select max(label) from main_next)) where length is not null""", "next_supp main_next")
def g3_constrained_walk(spark, sf):
    return _walk(materialize(v.main_next(spark, sf))).select((F.size("walk") - 1).alias("length"))


def _cases(cases: list[tuple[str, str]]) -> str:
    """Shortest walks from a to b, all of whose edges satisfy the one condition and one the other, by case; then the product along the first."""
    sql = """, e as (select src, dst, ['++', '+', 'g+', '-'][label % 4 + 1] as label from main_next), ends as (select min(src) as a, max(dst) as b from e)"""
    for i, (every, some) in enumerate(cases):
        for name, x, y, end in (("t", "src", "dst", "a"), ("u", "dst", "src", "b")):
            sql += f""", {name}{i}(id, hops, path) as (select {end}, 0, [{end}] from ends union all
  select * from (select e.{y}, t.hops + 1, min(list_append(t.path, e.{y})) from {name}{i} t join e on e.{x} = t.id where t.hops < 40 and ({every}) group by e.{y}, t.hops)),
m{name}{i} as (select id, min(hops) as hops, arg_min(path, hops) as path from {name}{i} group by id)"""
        sql += f""", w{i} as (select t.hops + 1 + u.hops as n, t.path || list_reverse(u.path) as walk from e join mt{i} t on t.id = e.src join mu{i} u on u.id = e.dst where ({every}) and ({some}) order by n, walk limit 1)"""
    sql += ", f as (select walk from (" + " union all ".join(f"select {i} as k, walk from w{i}" for i in range(len(cases))) + """) order by k limit 1),
s as (select walk, i, walk[i] as src, walk[i + 1] as dst from f, (select unnest(range(1, 200)) as i) where i < len(walk)),
l as (select walk, list(e.label order by i) as labels from s join e using (src, dst) group by walk), o as (select ['_', '*', '-', '+', 'g+', '++'] as o)
select walk, list_reduce(labels, lambda x, y: case when x = '-' and y = '-' then '+' else o[least(list_position(o, x), list_position(o, y))] end) as product from l, o"""
    return sql


@query(_cases([("label <> '_'", "label in ('*', '-', '+')"), ("label not in ('_', 'g+')", "true")]), "next_supp main_next")
def g4_bounded_walk_product(spark, sf):
    e = materialize(v.main_next(spark, sf))
    marks = F.element_at(F.array(*map(F.lit, ("++", "+", "g+", "-"))), (F.col("label") % 4 + 1).cast("int"))
    e = materialize(e.withColumn("label", marks))
    ends = e.agg(F.min("src").alias("a"), F.max("dst").alias("b")).first()
    cases = [(F.col("label") != "_", F.col("label").isin("*", "-", "+")), (~F.col("label").isin("_", "g+"), F.lit(True))]
    return p.bounded_walks(e, F.lit(ends["a"]), F.lit(ends["b"]), cases, POLARITY)


SCC = REACH.format(e="top_next") + """, n as (select src as node from top_next union select dst from top_next),
c as (select n.node, least(n.node, coalesce((select min(a.dst) from r a join r b on a.src = b.dst and a.dst = b.src where a.src = n.node), n.node)) as comp,
  exists (select 1 from r where r.src = n.node and r.dst = n.node) as cyclic from n)"""


def _scc(spark, sf):
    e = materialize(v.top_next(spark, sf))
    return e, materialize(p.strong_components(e, e.select(F.col("src").alias("id"))))


@query(SCC + " select node, comp, cyclic from c", "next_supp top_next")
def g5_strong_components(spark, sf):
    return _scc(spark, sf)[1]


_ORDER = """, k as (select distinct a.comp as src, b.comp as dst from {e} e join c a on a.node = e.src join c b on b.node = e.dst where a.comp <> b.comp),
lv(id, h) as (select comp, 0 from c where comp not in (select src from k) union select k.src, lv.h + 1 from lv join k on k.dst = lv.id),
m as (select id as comp, max(h) as level from lv group by id) select comp, level, row_number() over (order by level, comp) - 1 as place from m"""


@query(SCC + _ORDER.format(e="top_next"), "next_supp top_next")
def g5_component_order(spark, sf):
    return p.component_order(*_scc(spark, sf))


BLOCS = SCC.replace("top_next", "bloc_edges")


def _blocs(spark, sf):
    e = materialize(v.bloc_edges(spark, sf))
    return e, materialize(p.strong_components(e, e.select(F.col("src").alias("id"))))


@query(BLOCS + " select a.comp as src, b.comp as dst from bloc_edges e join c a on a.node = e.src join c b on b.node = e.dst where a.comp <> b.comp group by all", "next_supp bloc_edges")
def g6_condensation_blocs(spark, sf):
    """Of a graph with several large components, on every edge between suppliers that leads to no earlier bloc."""
    return p.condensation(*_blocs(spark, sf))


@query(BLOCS + _ORDER.format(e="bloc_edges"), "next_supp bloc_edges")
def g5_component_order_blocs(spark, sf):
    return p.component_order(*_blocs(spark, sf))


@query(SCC + " select distinct a.comp as src, b.comp as dst from top_next e join c a on a.node = e.src join c b on b.node = e.dst where a.comp <> b.comp", "next_supp top_next")
def g6_condensation(spark, sf):
    return p.condensation(*_scc(spark, sf))


@query(SCC + """, k as (select max(comp) as k from c) select c.node as id from c, k where (c.comp = k.k and c.cyclic) or (c.comp <> k.k and exists (select 1 from r join c m on m.node = r.src where m.comp = k.k and r.dst = c.node))""", "next_supp top_next")
def g6_component_reach(spark, sf):
    e, c = _scc(spark, sf)
    return p.component_reach(e, c, F.lit(c.agg(F.max("comp")).first()[0]))


@query(REACH.format(e="top_next").replace(", r", ", r", 1) + " select 'followers' as graph, not exists (select 1 from r where src = dst) as acyclic union all select 'parts', true", "next_supp top_next")
def g7_acyclic(spark, sf):
    rows = [("followers", p.is_acyclic(v.top_next(spark, sf))), ("parts", p.is_acyclic(v.dag_edges(spark, sf)))]
    return spark.createDataFrame(rows, "graph string, acyclic boolean")


def _squared(times: str, plus: str, steps: int = 5) -> str:
    """Closure of a small dense graph by repeated squaring, as a chain of tables."""
    out = ", c0 as (select * from trade_edges)"
    for i in range(steps):
        out += f", c{i + 1} as (select src, dst, {plus}(label) as label from (select * from c{i} union all select a.src, b.dst, {times} from c{i} a join c{i} b on a.dst = b.src) group by src, dst)"
    return out + f" select * from c{steps}"


@query(_squared("a.label + b.label", "min"), "trade trade_edges")
def g8_closure_min_plus(spark, sf):
    return p.closure(v.trade_edges(spark, sf), MIN_PLUS).drop("round")


@query(_squared("least(a.label, b.label)", "max"), "trade trade_edges")
def g8_closure_max_min(spark, sf):
    return p.closure(v.trade_edges(spark, sf), MAX_MIN).drop("round")


@query(", r(src, dst, round) as (select src, dst, 0 from dag_edges union select r.src, e.dst, r.round + 1 from r join dag_edges e on r.dst = e.src) select src, dst, min(round) as round from r group by src, dst", "dag_edges")
def g9_completion_rounds(spark, sf):
    e = v.dag_edges(spark, sf).withColumn("label", F.lit(True))
    return p.closure(e, BOOLEAN).select("src", "dst", "round")


PATHS = """, w(src, dst, length, paths) as (select id, id, 0, cast(1 as bigint) from (select src as id from dag_edges union select dst from dag_edges)
  union all select * from (select w.src, e.dst, w.length + 1, cast(sum(w.paths) as bigint) from w join dag_edges e on w.dst = e.src group by w.src, e.dst, w.length))"""


@query(PATHS + " select src, dst, max(length) as length, arg_max(paths, length) as paths from w group by src, dst", "dag_edges")
def g10_longest_paths(spark, sf):
    return p.longest_paths(v.dag_edges(spark, sf))


@query(""", l(id, n) as (select 1, 0 union select * from (select e.src, max(l.n) + 1 from l join dag_edges e on e.dst = l.id group by e.src)), m as (select id, max(n) as n from l group by id),
p(src, path) as (select 1, [1] union all select e.src, [e.src] || p.path from p join dag_edges e on e.dst = p.src join m on m.id = e.src and m.n = len(p.path)) select src, 1 as dst, array_to_string(path, ',') as path from p""", "dag_edges")
def g10_longest_path_lists(spark, sf):
    """All longest paths of every part to part 1."""
    e = materialize(v.dag_edges(spark, sf))
    ends = e.select("src").union(e.select("dst")).distinct().select("src", F.lit(1).cast("long").alias("dst"))
    return p.longest_path_lists(e, ends).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query(PATHS + " select e.src, e.dst, e.label from dag_edges e join (select src, dst, max(length) as m from w group by src, dst) l on l.src = e.src and l.dst = e.dst where l.m = 1", "dag_edges")
def g11_transitive_reduction(spark, sf):
    return p.transitive_reduction(materialize(v.dag_edges(spark, sf)))


@query(""", k as (select p_partkey as id from part where p_type <> 'ECONOMY'),
w(src, dst, label) as (select * from dag_edges where src in (select id from k) union all
  select * from (select w.src, e.dst, min(w.label + e.label) from w join dag_edges e on w.dst = e.src where w.dst not in (select id from k) group by w.src, e.dst))
select src, dst, min(label) as label from w where dst in (select id from k) group by src, dst""", "dag_edges")
def g12_drop_nodes_keep_paths(spark, sf):
    keep = table(spark, sf, "part").where("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("id"))
    return p.drop_nodes_keep_paths(v.dag_edges(spark, sf), keep, MIN_PLUS)


# Clusters: least label over shared lines, by a recursion on pairs of documents and their least neighbour.
@query(""", l as (select distinct doc_id, md5(line) as k from doc_lines), m as (select k, min(doc_id) as m from l group by k having count(*) > 1),
e as (select distinct l.doc_id as a, m.m as b from l join m on l.k = m.k where l.doc_id <> m.m), ee as (select a, b from e union select b, a from e),
r(a, b) as (select a, a from ee union select r.a, ee.b from r join ee on r.b = ee.a)
select d.doc_id as item, coalesce(x.c, d.doc_id) as cluster from (select doc_id from documents) d left join (select a, min(b) as c from r group by a) x on x.a = d.doc_id""", "doc_lines")
def g13_cluster(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.transform(F.filter(F.split("text", "\n", -1), lambda x: x != ""), F.md5).alias("keys"))
    return p.cluster(d, "item", "keys")


@query(""", f as (select src as id from top_next where src % 5 <> 0 union select dst from top_next where dst % 5 <> 0),
s as (select a.id as a, b.id as b from top_next e join f a on a.id = e.src join f b on b.id = e.dst where a.id <> b.id), ss as (select a, b from s union select b, a from s),
r(a, b) as (select id, id from f union select r.a, ss.b from r join ss on r.b = ss.a), c as (select a, min(b) as c from r group by a)
select e.src, e.dst, e.label, coalesce(x.c, y.c) as tree from top_next e left join c x on x.a = e.src left join c y on y.a = e.dst""", "next_supp top_next")
def g14_constraint_forest(spark, sf):
    e = materialize(v.top_next(spark, sf))
    flex = e.select(F.col("src").alias("id")).union(e.select("dst")).where("id % 5 <> 0")  # multiples of five are the rigid nodes
    return p.constraint_forest(e, flex)


@query(""", w(src, dst, label) as (select src, dst, label - 25 from dag_edges union select * from (select w.src, e.dst, min(w.label + e.label - 25) from w join dag_edges e on w.dst = e.src group by w.src, e.dst))
select src, dst, min(label) as label from w group by src, dst""", "dag_edges")
def g15_difference_constraints(spark, sf):
    return p.difference_constraints(v.dag_edges(spark, sf).withColumn("label", F.col("label") - 25))[0]


@query(""", t as (select src, dst, label % 100 - 30 as label from trade_edges), n as (select count(*) as n from (select src from t union select dst from t)),
w(src, dst, label, k) as (select src, dst, label, 1 from t union all select * from (select w.src, t.dst, min(w.label + t.label), w.k + 1 from w join t on t.src = w.dst, n where w.k <= n.n group by w.src, t.dst, w.k))
select distinct src as id from w where src = dst and label < 0""", "trade trade_edges")
def g15_negative_loops(spark, sf):
    """Nations on a loop of negative length: x - y <= label can't hold around it."""
    e = v.trade_edges(spark, sf).withColumn("label", F.col("label") % 100 - 30)
    return p.forced_to_infinity(materialize(e))


OFFSETS = """, w(src, dst, label) as (select src, dst, label - 25 from dag_edges union select * from (select w.src, e.dst, min(w.label + e.label - 25) from w join dag_edges e on w.dst = e.src group by w.src, e.dst))"""


@query(OFFSETS + " select id, least(0, coalesce((select min(label) from w where dst = id), 0)) as value from (select src as id from dag_edges union select dst from dag_edges)", "dag_edges")
def g15_offsets(spark, sf):
    """The greatest offsets of at most 0 that keep all constraints."""
    return p.consistent_offsets(v.dag_edges(spark, sf).withColumn("label", F.col("label") - 25))[0]


def _closed(spark, sf):
    """Each part to its half, and part 1 to the last one at a price below all: one negative loop."""
    h = v.dag_edges(spark, sf).where("dst = src div 2").select("src", "dst", F.lit(1).cast("long").alias("label"))
    return materialize(h.union(h.agg(F.lit(1).cast("long"), F.max("src"), F.lit(-1000).cast("long"))))


@query(""", h as (select src, dst from dag_edges where dst = src // 2), r(id, place) as (select max(src), cast(1 as bigint) from h union all select h.dst, r.place + 1 from r join h on h.src = r.id where h.dst > 1)
select 1 as loop, place, id from r union all select 1, 0, 1""", "dag_edges")
def g15_negative_loop(spark, sf):
    """The loop of a negative sum itself, from its smallest node on."""
    return p.consistent_offsets(_closed(spark, sf))[1]


@query(OFFSETS + """, h as (select src, dst, 1 as label from dag_edges where dst = src // 2 union all select 1, max(src), -1000 from dag_edges where dst = src // 2),
z(src, dst, label, n) as (select *, 1 from h union all select * from (select z.src, h.dst, min(z.label + h.label), z.n + 1 from z join h on z.dst = h.src where z.src = 1 and z.n < 60 group by z.src, h.dst, z.n))
select 'parts' as graph, not exists (select 1 from w where src = dst and label < 0) as consistent union all select 'closed', not exists (select 1 from z where src = dst and label < 0)""", "dag_edges")
def g15_consistency(spark, sf):
    graphs = {"parts": v.dag_edges(spark, sf).withColumn("label", F.col("label") - 25), "closed": _closed(spark, sf)}
    return spark.createDataFrame([(name, p.consistent_offsets(e)[1].isEmpty()) for name, e in graphs.items()], "graph string, consistent boolean")


@query(""", lv(id, h) as (select dst, 0 from dag_edges where dst not in (select src from dag_edges) union select e.src, lv.h + 1 from lv join dag_edges e on e.dst = lv.id)
select id, max(h) as level from lv group by id""", "dag_edges")
def s2_topological_levels(spark, sf):
    return p.topological_order(v.dag_edges(spark, sf))
