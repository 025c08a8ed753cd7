"""Centroid clustering in integers, with distances from scalar lookup tables.

Components are integers, and few different ones occur in a dimension of a batch. So a round tabulates, for each
dimension, the squared difference of every occurring value to every centroid; the distances of a batch are
then gathers from these tables, one a dimension, and their sums. Sums for the new centroids are added up
in tasks, then in Spark; the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .blocks import usable

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Differences of numbers up to this in size have squares of which 2**10 add up within 64 bits; beyond, tables hold Python's integers.
SMALL = 1 << 25
#: Components from here on aren't whole numbers of 64 bits with room for a difference.
LARGE = float(1 << 62)
#: Rows whose distances are held at a time, and low bits of a component that are summed apart from the rest.
PART, LOW = 2048, 31


def tabulated(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (of ties the first), and its squared distance: int64, or Python's integers if numbers are large."""
    limit = max([abs(x) for c in centroids for x in c] + [int(np.abs(vectors).max(initial=0))])
    kind = np.int64 if limit <= SMALL and vectors.shape[1] <= 1 << 10 else object
    centers = np.array(centroids, dtype=kind)
    out = np.zeros((len(vectors), len(centroids)), kind)
    for d in range(vectors.shape[1]):
        values, at = np.unique(vectors[:, d], return_inverse=True)
        values = values.astype(np.int64).astype(kind)
        out += ((values[:, None] - centers[None, :, d]) ** 2)[at]
    nearest = np.argmin(out, axis=1) if kind is np.int64 else np.array([min(range(len(r)), key=r.__getitem__) for r in out], np.int64)
    return nearest, out[np.arange(len(out)), nearest]


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for i in range(0, whole.num_rows, PART):
            b = whole.slice(i, PART)
            yield b, b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)


def _sums(rows: DataFrame, centroids: list[list[int]], dim: int) -> list[tuple[int, list[int]]]:
    """Number and component sums of the rows nearest to each centroid. A task gives at most one row for each centroid and dimension; the
    driver gets as many in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        counts, high, low = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros((k, dim), np.int64)
        for _, x in _batches(batches, dim):
            nearest, _ = tabulated(x, centroids)
            whole = x.astype(np.int64)
            counts += np.bincount(nearest, minlength=k)
            mine = np.zeros((k, len(x)))
            mine[nearest, np.arange(len(x))] = 1.0
            # parts of 31 bits of 2048 rows: sums of under 2**53 are exact in floating point
            high += (mine @ (whole >> LOW).astype(np.float64)).astype(np.int64)
            low += (mine @ (whole & ((1 << LOW) - 1)).astype(np.float64)).astype(np.int64)
        at = [(c, d) for c in np.flatnonzero(counts) for d in range(dim)]
        if at:
            columns = [[int(c) for c, _ in at], [d for _, d in at], [int(counts[c]) for c, _ in at], [int(high[x]) for x in at], [int(low[x]) for x in at]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32()] * 2 + [pa.int64()] * 3)], names=["cluster", "d", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    got = rows.select("vec").mapInArrow(run, "cluster int, d int, n long, high long, low long")
    out = [(0, [0] * dim) for _ in centroids]
    for cluster, d, n, high, low in got.groupBy("cluster", "d").agg(F.sum("n"), exact("high"), exact("low")).collect():
        out[cluster] = (n, out[cluster][1])
        out[cluster][1][d] = int(high) * (1 << LOW) + int(low)
    return out


def cluster(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", dim: int = DIM, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each vector of exactly dim finite, non-null components.

    Components become floor(scale x). The first centroids are the vectors with the smallest sha256 of 'seed:vec_id', in that order; as many as there are
    vectors, if fewer; equal ids by their components, a null id as an empty one. Every round assigns and replaces non-empty centroids by their vectors' floored means; a
    last assignment follows. Repeated rows count as often as they are there; an empty table gives no rows; other columns are ignored. All
    arithmetic is exact. A vector with a component beyond 2**62 after scaling has no place in whole numbers: its row comes with cluster and distance null and moves
    nothing; distances and sums of them beyond 64 bits are null too."""
    ok = usable(F.col("vec")) & (F.size("vec") == dim)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vec).cast("array<double>").alias("vec")).where(ok)
    large = F.exists("vec", lambda x: F.abs(x * scale) >= LARGE)
    # floor() of a double is a whole number within 64 bits here, and that double is itself exact
    whole = F.transform("vec", lambda x: F.when(F.abs(x * scale) < LARGE, F.floor(x * scale)).cast("double"))
    rows = materialize(rows.select("vec_id", F.when(~large, whole).alias("vec")))
    some, none = rows.where("vec is not null"), rows.where("vec is null")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = some.select(digest.alias("h"), "vec").orderBy("h", "vec").limit(clusters).collect()  # clusters rows
    centroids = [[int(x) for x in r["vec"]] for r in first]
    schema = "vec_id " + rows.schema["vec_id"].dataType.simpleString() + ", cluster int, distance decimal(38,0)"
    if not centroids:
        found = none.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("decimal(38,0)").alias("distance"))
    else:
        for _ in range(rounds):
            sums = _sums(some, centroids, dim)
            centroids = [[s // n for s in total] if n else old for (n, total), old in zip(sums, centroids)]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, x in _batches(batches, dim):
                nearest, distance = tabulated(x, centroids)
                fits = [int(v) if v < 10**38 else None for v in distance]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(nearest, pa.int32()), pa.array(fits, pa.decimal128(38, 0))], names=["vec_id", "cluster", "distance"])

        found = some.mapInArrow(assign, schema).unionByName(none.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("decimal(38,0)").alias("distance")))
    found = materialize(found)
    inertia = lambda c: c.try_cast("bigint")
    # centroids rows: a group for each, and one for vectors without a place
    own = found.groupBy("cluster").agg(F.count("*").alias("n"), F.count("distance").alias("known"), F.sum("distance").alias("sum")).collect()
    complete = all(r["n"] == r["known"] for r in own if r["cluster"] is not None)
    total = sum(int(r["sum"] or 0) for r in own)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(r["cluster"], int(r["sum"]) if r["n"] == r["known"] and r["sum"] < 1 << 63 else None, hashes[r["cluster"]]) for r in own if r["cluster"] is not None]
    facts = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster", "left")  # one row a centroid
    return out.select("vec_id", "cluster", inertia(F.col("distance")).alias("distance"), "cluster_inertia", F.lit(total if complete and total < 1 << 63 else None).cast("long").alias("inertia"), "centroid_sha256")
