"""Queries that pass functions of the user's through the operators (F1 to F5)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semiring import Semiring
from ..operators import graph, grouping, matrix, paths
from ..sources.tables import materialize, table
from . import views as v
from .base import query


@query("select src, dst, cast(sum(label % 7) as bigint) as label from trade group by src, dst", "trade")
def f1_combine_function(spark, sf):
    """Labels of an edge put together by an aggregate of the user's."""
    return graph.build_with(v.trade(spark, sf), lambda label: F.sum(label % 7))


@query("select a.src as i, b.dst as j, min(greatest(a.label, b.label)) as v from trade_edges a join trade_edges b on a.dst = b.src group by a.src, b.dst", "trade trade_edges")
def f2_semiring(spark, sf):
    """A product over the bottleneck semiring: the least possible largest label of two steps."""
    e = materialize(v.trade_edges(spark, sf).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("label").alias("v")))
    return matrix.multiply(e, e, Semiring("bottleneck", F.min, F.greatest), F.lit(-1))


@query(""", e as (select src, dst from trade_edges where label % 3 <> 0 and src <> dst), b(id, hops) as (select min(src), 0 from e union select e.dst, b.hops + 1 from b join e on e.src = b.id where b.hops < 25)
select id, min(hops) as hops from b group by id""", "trade trade_edges")
def f3_edge_predicate(spark, sf):
    """What is reached over the edges that satisfy a predicate."""
    e = materialize(v.trade_edges(spark, sf).where((F.col("label") % 3 != 0) & (F.col("src") != F.col("dst"))))
    return paths.reachable(e, e.agg(F.min("src").alias("id")))


@query("""select o_orderkey, cast(sum(s) over (partition by o_custkey order by o_orderkey) as bigint) as run from (
select *, case when abs(o_totalprice - lag(o_totalprice) over (partition by o_custkey order by o_orderkey)) < 50000 then 0 else 1 end as s from orders)""")
def f4_pair_function(spark, sf):
    """Runs of a customer's orders by a relation between neighbours."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return grouping.runs(o, "o_custkey", "o_orderkey", lambda before: F.abs(F.col("o_totalprice") - before["o_totalprice"]) < 50000).select("o_orderkey", "run")


@query("""with n as (select s_suppkey, [s_nationkey, s_suppkey % 10] as p, lead([s_nationkey, s_suppkey % 10]) over (partition by s_nationkey % 5 order by s_suppkey) as q from supplier),
d as (select s_suppkey, sign(p[1] - q[1]) as a, sign(p[2] - q[2]) as b from n where q is not null)
select s_suppkey, case when a = 0 and b = 0 then 'EQ' when a < 0 and b < 0 then 'LT' when a > 0 and b > 0 then 'GT' when a <= 0 and b <= 0 then 'LE' when a >= 0 and b >= 0 then 'GE' else 'Any' end as relation from d""")
def f5_partial_order(spark, sf):
    """Each supplier against the next of its group in the pointwise order."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), F.array(F.col("s_nationkey").cast("long"), F.col("s_suppkey") % 10).alias("p"))
    s = s.withColumn("q", F.lead("p").over(W.partitionBy(F.col("n") % 5).orderBy("s_suppkey"))).where("q is not null")
    return s.select("s_suppkey", grouping.pointwise(F.col("p"), F.col("q")).alias("relation"))
