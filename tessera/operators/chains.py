"""Chains of nodes with one successor each, followed by pointer doubling.

A round doubles the length of every pointer, so a chain of n nodes takes about log2(n) rounds, and only nodes that
have not come to a chain's end are written again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize_counting


@dataclass
class Chains:
    #: (id, root, dist): nodes whose chain ends at root, the first node without one successor, dist edges on.
    ended: DataFrame
    #: For i = 0, 1, ..: (id, to) of the nodes whose successor 2**i edges on is a node of a chain.
    jumps: list[DataFrame]
    #: (id, comp): nodes on circles, with the smallest node of theirs; and (id): nodes that lead to one or lie on one.
    circles: DataFrame
    endless: DataFrame


def follow(nxt: DataFrame, name_circles: bool = True) -> Chains:
    """Follow the chains of nxt(id, to), one row an id. Without name_circles, circles is null and the rounds end as soon as it is known who is endless."""
    ids = nxt.select(F.col("id").alias("to"), F.lit(True).alias("_on"))
    step = nxt.join(ids, "to", "left").select("id", "to", F.lit(1).cast("long").alias("dist"), F.col("id").alias("least"), F.col("_on").isNotNull().alias("open"))
    step, n = materialize_counting(step, F.col("open"))
    ended, jumps, length, before = [step.where("not open")], [], 1, -1
    while n and n != before or name_circles and n and length < n:
        live = step.where("open")
        jumps.append(live.select("id", "to"))
        # an unchanged number: nobody ends between 1 and 2 lengths from here, so nobody ends any more
        known = [live] if n == before else [live, *ended]
        there = reduce(DataFrame.unionByName, known).select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("least").alias("_least"), F.col("open").alias("_open"))
        far = live.join(there, "to").select("id", F.col("_to").alias("to"), (F.col("dist") + F.col("_dist")).alias("dist"), F.least("least", "_least").alias("least"), F.col("_open").alias("open"))
        before = n
        step, n = materialize_counting(far, F.col("open"))
        ended.append(step.where("not open"))
        length *= 2
    live = step.where("open")
    if name_circles and n:
        jumps.append(live.select("id", "to"))
    # as many edges on as there are endless nodes all are on circles, and have seen all of theirs from there
    circles = live.select("to").distinct().join(live.select(F.col("id").alias("to"), "least"), "to").select(F.col("to").alias("id"), F.col("least").alias("comp"))
    return Chains(reduce(DataFrame.unionByName, ended).select("id", F.col("to").alias("root"), "dist"), jumps, circles if name_circles else None, live.select("id"))
