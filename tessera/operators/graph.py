"""Graphs as edge tables edges(src, dst, label), at most one row for each (src, dst), and nodes(id).

Order-sensitive builders take an explicit sequence column. All functions are joins, groupings and
projections; a hub's fan-out is left to adaptive skew joins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize

E3 = ("src", "dst", "label")


# -- projections and filters ----------------------------------------------------------------------


def map_edges(edges: DataFrame, label: Column) -> DataFrame:
    """New label from src, dst and label."""
    return edges.withColumn("label", label)


def map_self_loops(edges: DataFrame, label: Column) -> DataFrame:
    """New label where src = dst only."""
    return edges.withColumn("label", F.when(F.col("src") == F.col("dst"), label).otherwise(F.col("label")))


def transpose(edges: DataFrame) -> DataFrame:
    """src and dst swapped. Isolated nodes stay as they are: nodes are a table of their own."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def drop_null_edges(edges: DataFrame, null: Column | None = None) -> DataFrame:
    """Edges whose label is not the null label (by default: SQL null)."""
    return edges.where(F.col("label").isNotNull() if null is None else F.col("label").isNotNull() & (F.col("label") != null))


def is_discrete(edges: DataFrame, null: Column | None = None) -> bool:
    """No edge but null ones."""
    return drop_null_edges(edges, null).isEmpty()


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def split_labels(edges: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """One graph of pair labels (a struct with these fields) to two graphs."""
    return tuple(edges.select("src", "dst", F.col("label")[f].alias("label")) for f in (first, second))


# -- joins ----------------------------------------------------------------------------------------


def edge_lookup(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The label of each pair (src, dst), null where there is no edge."""
    return pairs.join(edges, ["src", "dst"], "left")


def edges_from(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outgoing edges of nodes(id); a node listed twice repeats its edges."""
    return nodes.select(F.col("id").alias("src")).join(edges, "src").select(*edges.columns)


def edges_to(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Incoming edges of nodes(id), with repeats as in edges_from."""
    return nodes.select(F.col("id").alias("dst")).join(edges, "dst").select(*edges.columns)


def _at(nodes: DataFrame, end: str) -> DataFrame:
    return nodes.select(F.col("id").alias(end)).distinct()


def keep_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(id)."""
    return edges.join(_at(nodes, "src"), "src", "left_semi").join(_at(nodes, "dst"), "dst", "left_semi").select(*edges.columns)


def remove_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with neither end in nodes(id)."""
    return edges.join(_at(nodes, "src"), "src", "left_anti").join(_at(nodes, "dst"), "dst", "left_anti").select(*edges.columns)


def remove_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*edges.columns)


def compose(c: DataFrame, d: DataFrame, times: Callable[[Column, Column], Column], plus: Callable[[Column], Column]) -> DataFrame:
    """edge(s, u) = plus over t of times(c(s, t), d(t, u)); plus is an aggregate."""
    left = c.select("src", F.col("dst").alias("_mid"), F.col("label").alias("_l"))
    right = d.select(F.col("src").alias("_mid"), "dst", F.col("label").alias("_r"))
    return left.join(right, "_mid").groupBy("src", "dst").agg(plus(times(F.col("_l"), F.col("_r"))).alias("label"))


def rename_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply an injective mapping(id, new) to both ends."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    a = mapping.select(F.col("id").alias("src"), F.col("new").alias("_src"))
    b = mapping.select(F.col("id").alias("dst"), F.col("new").alias("_dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest)


def common_successors(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id): targets with an edge from every one of sources(id); none if sources is empty."""
    s = sources.select(F.col("id").alias("src")).distinct()
    hit = edges.select("src", "dst").distinct().join(s, "src").groupBy("dst").count()
    return hit.crossJoin(F.broadcast(s.agg(F.count("*").alias("_all")))).where("count = _all").select(F.col("dst").alias("id"))


def common_predecessors(edges: DataFrame, targets: DataFrame) -> DataFrame:
    return common_successors(transpose(edges), targets)


def relative_minima(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of nodes(id) without a predecessor in the set by an edge of weight <= 0, loops excluded."""
    inside = keep_nodes(edges, nodes).where("src <> dst and label <= 0")
    return nodes.distinct().join(inside.select(F.col("dst").alias("id")), "id", "left_anti")


def relative_maxima(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return relative_minima(transpose(edges), nodes)


def implication_violators(g: DataFrame, h: DataFrame, skip: Column) -> DataFrame:
    """Edges of g, but those that skip holds for, without an edge of h of smaller or equal label; g
    implies h if there are none. skip speaks of src, dst and label of g."""
    other = h.select("src", "dst", F.col("label").alias("other"))
    return g.where(~skip).join(other, ["src", "dst"], "left").where("other is null or other > label").select("src", "dst", "label", "other")


# -- building and summing up ----------------------------------------------------------------------


def build_last(rows: DataFrame, seq: str) -> DataFrame:
    """One edge for each (src, dst): the last row in the order of seq wins."""
    return rows.groupBy("src", "dst").agg(F.max_by("label", seq).alias("label"))


def build_with(rows: DataFrame, plus: Callable[[Column], Column]) -> DataFrame:
    """Duplicates combined by an aggregate."""
    return rows.groupBy("src", "dst").agg(plus(F.col("label")).alias("label"))


def build_fold(rows: DataFrame, seq: str, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Duplicates combined as combine(new, old) in the order of seq; for combinations that are no
    aggregate. The labels of one edge are held together."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("label").alias("l"))))
    rest = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    grouped = rows.groupBy("src", "dst").agg(ordered.alias("a"))
    return grouped.select("src", "dst", F.aggregate(rest(F.col("a")), F.col("a")[0]["l"], lambda old, x: combine(x["l"], old)).alias("label"))


def node_sets(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, is_source, is_target, is_isolated) of all nodes, by one grouping."""
    parts = [edges.select(F.col("src").alias("id"), F.lit(True).alias("s"), F.lit(False).alias("t")), edges.select(F.col("dst").alias("id"), F.lit(False).alias("s"), F.lit(True).alias("t"))]
    if nodes is not None:
        parts.append(nodes.select("id", F.lit(False).alias("s"), F.lit(False).alias("t")))
    g = reduce(DataFrame.union, parts).groupBy("id").agg(F.bool_or("s").alias("is_source"), F.bool_or("t").alias("is_target"))
    return g.withColumn("is_isolated", ~F.col("is_source") & ~F.col("is_target"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, degree, neighbours map of dst to label)."""
    return edges.groupBy("src").agg(F.count("*").alias("degree"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("dst", "label")))).alias("neighbours"))


def bounds(edges: DataFrame, flexible: DataFrame, infinity: Column) -> DataFrame:
    """For each flexible node(id): its lower bounds (sources of edges into it), upper bounds (targets other
    than infinity of edges out of it), both sorted sets, and whether it must be finite (it has an edge
    of a negative label into infinity)."""
    low = edges.select(F.col("dst").alias("id"), F.col("src").alias("low"), F.lit(None).cast(edges.schema["dst"].dataType).alias("up"), F.lit(False).alias("f"))
    up = edges.select(F.col("src").alias("id"), F.lit(None).cast(edges.schema["src"].dataType).alias("low"), F.when(F.col("dst") != infinity, F.col("dst")).alias("up"), ((F.col("dst") == infinity) & (F.col("label") < 0)).alias("f"))
    g = low.union(up).join(flexible.select("id").distinct(), "id").groupBy("id")
    return g.agg(F.sort_array(F.collect_set("low")).alias("lower_bounds"), F.sort_array(F.collect_set("up")).alias("upper_bounds"), F.bool_or("f").alias("must_be_finite"))


def reflexive_closure(edges: DataFrame, nodes: DataFrame, zero: Column, infinity: Column, unit: Column) -> DataFrame:
    """zero -> n, n -> n and n -> infinity with the unit label for every node, meeting (minimum) what is there."""
    n = nodes.select("id").distinct()
    ends = [(zero, F.col("id")), (F.col("id"), F.col("id")), (F.col("id"), infinity)]
    more = [n.select(a.alias("src"), b.alias("dst"), unit.alias("label")) for a, b in ends]
    return reduce(DataFrame.union, [edges.select(*E3), *more]).groupBy("src", "dst").agg(F.min("label").alias("label"))


# -- set operations -------------------------------------------------------------------------------


def union_left(*graphs: DataFrame) -> DataFrame:
    """n-ary union; of edges in several graphs the first graph's label wins."""
    ranked = [g.select(*E3, F.lit(i).alias("_rank")) for i, g in enumerate(graphs)]
    return reduce(DataFrame.unionByName, ranked).groupBy("src", "dst").agg(F.min_by("label", "_rank").alias("label"))


def union_with(plus: Callable[[Column], Column], *graphs: DataFrame) -> DataFrame:
    """n-ary union; labels of shared edges are combined by an aggregate."""
    return build_with(reduce(DataFrame.unionByName, [g.select(*E3) for g in graphs]), plus)


# -- numbering ------------------------------------------------------------------------------------


def dense_ids(df: DataFrame, key: str, name: str = "node_id") -> DataFrame:
    """(key, id): 0-based dense ids of the distinct values of key in ascending order.

    Values are range-partitioned and sorted; an id is the place in its partition after the sizes of the partitions
    before it. Only one count for each partition is gathered.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = df.select(key).distinct().repartitionByRange(n, key).sortWithinPartitions(key)
    parts = materialize(parts.select(key, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))
    before, offsets = 0, []
    for r in parts.groupBy("_part").count().orderBy("_part").collect():  # one row a partition
        offsets.append((r["_part"], before))
        before += r["count"]
    table = spark.createDataFrame(offsets, "_part int, _before long")
    return parts.join(F.broadcast(table), "_part").select(key, (F.col("_before") + F.col("_place")).alias(name))
