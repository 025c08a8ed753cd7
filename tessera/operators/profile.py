"""Counters, time bills and the profile report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchy import preorder, rollup_sums


def counters(ticks: DataFrame) -> DataFrame:
    """(kind, name, value) of ticks(name, kind, n): sums of kind 'sum' and maxima of kind 'max'."""
    return ticks.groupBy("kind", "name").agg(F.when(F.col("kind") == "max", F.max("n")).otherwise(F.sum("n")).alias("value"))


def profile_report(bills: DataFrame, least_ms: int = 10) -> DataFrame:
    """(position, account, own, aggregate) of bills(path, value): nodes whose subtree exceeds least_ms in pre-order by falling own time, aggregate only where it
    differs from own and not at the root; then Total, the sum of the own times shown. The empty account is "Miscellaneous"."""
    nodes = rollup_sums(bills).where(F.col("total") > least_ms)
    order = preorder(nodes.select("path", F.col("total").alias("value"))).select("path", "position")
    rows = nodes.join(order, "path")
    name = F.when(F.size("path") == 0, "Miscellaneous").otherwise(F.array_join("path", "."))
    body = rows.select("position", name.alias("account"), F.coalesce("own", F.lit(0)).cast("long").alias("own"), F.when((F.size("path") > 0) & (F.coalesce("own", F.lit(0)) != F.col("total")), F.col("total")).cast("long").alias("aggregate"))
    total = body.agg(F.lit(0).cast("long").alias("position"), F.lit("Total").alias("account"), F.coalesce(F.sum("own"), F.lit(0)).alias("own"), F.lit(None).cast("long").alias("aggregate"))
    return total.unionByName(body)
