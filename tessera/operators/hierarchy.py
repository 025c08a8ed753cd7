"""Path tables paths(path array<string>, value): prefix sums, subtrees, compression, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixes(path: Column) -> Column:
    """All prefixes of a path, root and the path itself included."""
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda n: F.slice(path, 1, n))


def every_prefix(paths: DataFrame) -> DataFrame:
    rest = [c for c in paths.columns if c != "path"]
    return paths.select(F.explode(prefixes(F.col("path"))).alias("path"), *rest)


def values_along(paths: DataFrame, probes: DataFrame) -> DataFrame:
    """probes(key) with values: those at its prefixes, root first."""
    p = probes.select("key", F.explode(prefixes(F.col("key"))).alias("path")).join(paths, "path")
    got = p.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.size("path").alias("n"), "value"))), lambda x: x["value"]).alias("values"))
    return probes.select("key").distinct().join(got, "key", "left").select("key", F.coalesce("values", F.array().cast(got.schema["values"].dataType)).alias("values"))


def subtree(paths: DataFrame, prefix: list[str]) -> DataFrame:
    """Entries under a prefix, the prefix removed."""
    at = F.array(*map(F.lit, prefix)).cast("array<string>")
    n = len(prefix)
    return paths.where(F.slice("path", 1, n) == at if n else F.lit(True)).withColumn("path", F.slice("path", n + 1, F.greatest(F.size("path"), F.lit(1))))


def prefix_by(paths: DataFrame, prefix: list[str]) -> DataFrame:
    return paths.withColumn("path", F.concat(F.array(*map(F.lit, prefix)).cast("array<string>"), "path"))


def union_with(plus, *tables: DataFrame) -> DataFrame:
    """Union of path tables, values of a path combined by an aggregate."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("path").agg(plus(F.col("value")).alias("value"))


def delete(paths: DataFrame, path: list[str]) -> DataFrame:
    return paths.where(F.col("path") != F.array(*map(F.lit, path)))


def adjust(paths: DataFrame, path: list[str], value: Column) -> DataFrame:
    return paths.withColumn("value", F.when(F.col("path") == F.array(*map(F.lit, path)), value).otherwise(F.col("value")))


def rollup_sums(paths: DataFrame) -> DataFrame:
    """(path, own, total): for every node, inner ones included, its own value (null if none) and the sum of its subtree. Paths are summed
    before they are exploded."""
    full = paths.groupBy("path").agg(F.sum("value").alias("value"))
    e = full.select(F.explode(prefixes(F.col("path"))).alias("prefix"), "path", "value")
    return e.groupBy(F.col("prefix").alias("path")).agg(F.max(F.when(F.col("prefix") == F.col("path"), F.col("value"))).alias("own"), F.sum("value").alias("total"))


def _children(paths: DataFrame) -> DataFrame:
    """(path, children, valued) of every node."""
    nodes = every_prefix(paths.select("path")).distinct()
    kids = nodes.where(F.size("path") > 0).select(F.slice("path", 1, F.size("path") - 1).alias("path")).groupBy("path").agg(F.count("*").alias("children"))
    valued = paths.select("path", F.lit(True).alias("valued")).distinct()
    return nodes.join(kids, "path", "left").join(valued, "path", "left").select("path", F.coalesce("children", F.lit(0).cast("long")).alias("children"), F.coalesce("valued", F.lit(False)).alias("valued"))


def compress(paths: DataFrame) -> DataFrame:
    """(path, segments, valued): nodes that stay when chains of valueless nodes with one child are merged (valued ones, leaves, branchings and the
    root), and their path as merged segments, each an array of keys."""
    kept = _children(paths).where((F.size("path") == 0) | F.col("valued") | (F.col("children") != 1))
    marks = kept.select("path", "valued", F.explode(prefixes(F.col("path"))).alias("prefix")).join(kept.select(F.col("path").alias("prefix")), "prefix")
    cuts = marks.groupBy("path").agg(F.first("valued").alias("valued"), F.sort_array(F.collect_list(F.size("prefix"))).alias("cuts"))
    pairs = F.transform(F.sequence(F.lit(2), F.size("cuts")), lambda i: F.slice("path", F.element_at("cuts", i - 1) + 1, F.element_at("cuts", i) - F.element_at("cuts", i - 1)))
    return cuts.select("path", F.when(F.size("cuts") > 1, pairs).otherwise(F.array().cast("array<array<string>>")).alias("segments"), "valued")


def uncompress(compressed: DataFrame) -> DataFrame:
    return compressed.withColumn("path", F.flatten("segments"))


def sizes(paths: DataFrame) -> DataFrame:
    """(size, size_with_leaves): valued nodes; valued nodes or leaves."""
    return _children(paths).agg(F.count_if("valued").alias("size"), F.count_if(F.col("valued") | (F.col("children") == 0)).alias("size_with_leaves"))


def deepest_setting(settings: DataFrame, probes: DataFrame, default: Column) -> DataFrame:
    """probes(key) with value: the one at the longest prefix of the key that has one, else the default."""
    p = probes.select("key", F.explode(prefixes(F.col("key"))).alias("path")).join(settings, "path")
    got = p.groupBy("key").agg(F.max_by("value", F.size("path")).alias("value"))
    return probes.select("key").distinct().join(got, "key", "left").select("key", F.coalesce("value", default).alias("value"))


def truncate_depth(paths: DataFrame, depth: int) -> DataFrame:
    """Nodes of the compressed tree no deeper than depth; at that depth leaves only."""
    c = compress(paths).withColumn("depth", F.size("segments"))
    leaf = _children(paths).select("path", (F.col("children") == 0).alias("leaf"))
    return c.join(leaf, "path").where((F.col("depth") < depth) | ((F.col("depth") == depth) & F.col("leaf"))).select("path", "segments", "valued", "depth", "leaf")


def cut_sizes(paths: DataFrame) -> DataFrame:
    """(depth, nodes): nodes that each truncation by depth leaves: all above, and the leaves at the depth."""
    c = compress(paths).join(_children(paths).select("path", (F.col("children") == 0).alias("leaf")), "path")
    per = c.groupBy(F.size("segments").alias("depth")).agg(F.count("*").alias("n"), F.count_if("leaf").alias("leaves"))
    from pyspark.sql import Window as W

    above = F.coalesce(F.sum("n").over(W.orderBy("depth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a depth
    return per.select("depth", (above + F.col("leaves")).alias("nodes"))


def truncate_size(paths: DataFrame, n: int) -> DataFrame:
    """The deepest cut that leaves fewer than n nodes."""
    best = cut_sizes(paths).where(F.col("nodes") < n).agg(F.max("depth")).first()[0]
    return truncate_depth(paths, -1 if best is None else best)


def preorder(paths: DataFrame, descending: bool = True) -> DataFrame:
    """paths with position (from 1): pre-order, siblings ordered by their node's value (missing ones first), then key. The sort key of a
    path lists the values and keys of its prefixes."""
    from .graph import dense_ids

    sign = -1 if descending else 1
    steps = paths.select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n")).where(F.size("path") > 0)
    at = paths.select(F.col("path").alias("_p"), (F.col("value") * sign).cast("double").alias("_v"))
    s = steps.withColumn("_p", F.slice("path", 1, F.col("n"))).join(at, "_p", "left")
    key = F.transform(F.sort_array(F.collect_list(F.struct("n", F.coalesce("_v", F.lit(float("-inf"))).alias("v"), F.element_at("path", F.col("n")).alias("k")))), lambda x: F.struct(x["v"].alias("v"), x["k"].alias("k")))
    keys = s.groupBy("path").agg(key.alias("sort_key"))
    out = paths.join(keys, "path", "left").withColumn("sort_key", F.coalesce("sort_key", F.array().cast(keys.schema["sort_key"].dataType)))
    ids = dense_ids(out, "sort_key", "_id")
    return out.join(ids, "sort_key").select(*paths.columns, (F.col("_id") + 1).alias("position"))


def complete(paths: DataFrame, typed: list[str], n: int) -> DataFrame:
    """(completion, extension): under a typed prefix the completions of a size-truncated subtree, and the unambiguous extension: the keys that all entries
    below share."""
    below = subtree(paths, typed).where(F.size("path") > 0)
    ends = below.agg(F.min("path").alias("a"), F.max("path").alias("b"))
    same = F.filter(F.sequence(F.lit(0), F.least(F.size("a"), F.size("b"))), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    ext = ends.select(F.slice("a", 1, F.array_max(same)).alias("extension"))
    kept = truncate_size(below, n).where(F.size("path") > 0).select(F.col("path").alias("completion"))
    return kept.crossJoin(F.broadcast(ext))  # one row
