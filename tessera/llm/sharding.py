"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A group (documents with equal texts) goes to one shard whole. A partial partition is a tuple of as many
parts as there are shards. Differencing repeatedly combines the two partial partitions with the largest
spread (largest part less smallest), the largest part of one with the smallest of the other, and so on.

Groups are summed first, then differenced in Spark tasks, one bucket of groups (by hash) at a time, which leaves
one partial partition for each bucket. FAN buckets at a time are differenced in the same way to one, in tasks again,
level by level until one is left; every level writes where the parts of its buckets went.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .common import ceil_div

SHARDS = 40
#: Groups of a bucket, partial partitions combined by a task, and documents of a slot bucket within a shard.
GROUPS, FAN, SLOTS = 20_000, 256, 20_000


def difference(sizes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each number, and the parts' sums, by Karmarkar-Karp differencing."""
    return combine([np.array([s] + [0] * (parts - 1), np.int64) for s in sizes], parts, one_each=True)


def combine(tuples: list[np.ndarray], parts: int, one_each: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions to one.

    one_each: each tuple holds a single number, in its first part. Returns, for each tuple, where its
    parts went ((tuples,) with one_each, else (tuples, parts)), and the sums.
    """
    n = len(tuples)
    if not n:
        return np.zeros((0,) if one_each else (0, parts), np.int64), np.zeros(parts, np.int64)
    # members[i][p]: a list of (tuple, part) in part p of live partition i, as a linked tree
    heap, live = [], []
    for i, t in enumerate(tuples):
        order = np.argsort(-t, kind="stable")
        live.append((t[order], [((i, int(p)) if t[p] or not one_each else None) for p in order]))
        heap.append((int(t.min() - t.max()), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        (a, ta), (b, tb) = live[i], live[j]
        total = a + b[::-1]
        order = np.argsort(-total, kind="stable")
        trees = [x if y is None else y if x is None else (x, y, None) for x, y in zip(ta, tb[::-1])]
        live[i] = live[j] = None
        live.append((total[order], [trees[k] for k in order]))
        heapq.heappush(heap, (int(total[order[-1]] - total[order[0]]), len(live) - 1))
    sums, trees = live[heap[0][1]]
    out = np.zeros(n if one_each else (n, parts), np.int64)
    for shard, tree in enumerate(trees):
        stack = [tree]
        while stack:
            x = stack.pop()
            if x is None:
                continue
            if len(x) == 3:
                stack += x[:2]
            elif one_each:
                out[x[0]] = shard
            else:
                out[x[0], x[1]] = shard
    return out, sums


def _one_level(partial: DataFrame, shards: int) -> DataFrame:
    """(bucket, part, bytes, up, to): each FAN buckets of partial(bucket, part, bytes) become the bucket up, their parts its parts to."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "part"])
        names, at = np.unique(pdf["bucket"], return_inverse=True)
        sums = np.zeros((len(names), shards), np.int64)
        sums[at, pdf["part"]] = pdf["bytes"]
        return pdf.assign(to=combine(list(sums), shards)[0][at, pdf["part"]])

    up = F.floor(F.col("bucket") / FAN).cast("long")
    return partial.withColumn("up", up).groupBy("up").applyInPandas(run, "bucket long, part long, bytes long, up long, to long")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """One row for each document: doc_id, size (UTF-8 bytes of the text and overhead), text_crc32, shard
    (0 to shards - 1) and slot (gapless from 0 in each shard).

    Documents of equal texts form a group, and so do those without a text (size: the overhead alone,
    text_crc32 null); a group is never divided, so a group larger than a shard's fair share makes its
    shard larger. Repeated rows have slots of their own; null ids stay; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.md5(text), F.lit("")).alias("grp"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = materialize(rows)
    groups = materialize(rows.groupBy("grp").agg(F.sum("size").alias("bytes")))
    buckets = ceil_div(groups.count(), GROUPS)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches) or [pd.DataFrame({"grp": [], "bytes": [], "bucket": []})])  # whole buckets, of about GROUPS rows each
        for bucket, own in pdf.groupby("bucket"):
            own = own.sort_values(["bytes", "grp"], ascending=[False, True])
            yield own.assign(part=difference(own["bytes"].to_numpy(), shards)[0])[["grp", "bytes", "bucket", "part"]]

    placed = groups.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets))).repartition(buckets, "bucket")
    placed = materialize(placed.mapInPandas(local, "grp string, bytes long, bucket long, part long"))
    where = placed.select("grp", "bucket", "part")
    partial = placed.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))  # shards rows a bucket
    while True:
        partial = materialize(partial)
        buckets = ceil_div(buckets, FAN)
        moved = materialize(_one_level(partial, shards))
        where = where.join(moved.select("bucket", "part", "up", "to"), ["bucket", "part"]).select("grp", F.col("up").alias("bucket"), F.col("to").alias("part"))
        if buckets == 1:
            break
        partial = moved.groupBy(F.col("up").alias("bucket"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))
    where = where.select("grp", F.col("part").cast("int").alias("shard"))

    out = rows.join(where, "grp").select("doc_id", "size", "text_crc32", "shard")
    # slots: documents of a shard in hash buckets, numbered within each after the buckets before it
    slot_buckets = ceil_div(rows.count(), shards * SLOTS)
    out = materialize(out.withColumn("sb", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slot_buckets))))
    before = out.groupBy("shard", "sb").count().select("shard", "sb", (F.sum("count").over(W.partitionBy("shard").orderBy("sb")) - F.col("count")).alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "sb").orderBy("doc_id", "text_crc32")) - 1
    return out.withColumn("number", number).join(before, ["shard", "sb"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"))
