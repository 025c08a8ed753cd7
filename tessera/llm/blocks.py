"""A stated query set against all rows of a vector table, block by block.

The rows are dealt into blocks; a task reads its block once and makes what it needs of it (an index, a
matrix) once; then the queries stream past in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .common import ceil_div

#: Rows of a block at most: with 64 numbers a row, 8 MB. Every query goes to every block, so larger blocks move less;
#: FEWEST rows make a block while cores are idle.
ROWS, FEWEST = 16384, 1024
#: Queries answered at a time.
PART = 256


def usable(vec: Column) -> Column:
    """Not null and without null or non-finite components."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


@dataclass
class Vectors:
    """A written table (rid, block, id, vec) of the rows that take part, all of length dim, and what is known of it."""

    table: DataFrame
    dim: int
    blocks: int
    #: The greatest squared length, and the greatest size of a component.
    longest: float
    largest: float

    def query_rows(self, every: int) -> DataFrame:
        """(id, rid, vec) of all rows whose id is divisible by every."""
        return materialize(self.table.where(F.pmod("id", F.lit(every)) == 0).select("id", "rid", "vec"))


def stored(df: DataFrame, vec_id: str, vec: str, among: Callable[[Column], Column] | None = None) -> Vectors:
    """The usable rows that have an id and satisfy among(vec). Vectors shorter than the longest count as zero beyond their end."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(usable(F.col("vec")) & F.col("id").isNotNull())
    rows = rows.where(among(F.col("vec"))) if among else rows
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    known = rows.agg(F.max(F.size("vec")), F.count("*"), F.max(squares), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    dim, n = known[0] or 0, known[1]
    whole = F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec"))))
    blocks = max(ceil_div(n, ROWS), min(df.sparkSession.sparkContext.defaultParallelism, ceil_div(n, FEWEST)))
    table = materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "id", whole.alias("vec")))
    # by row, not by id: an id that very many rows share is dealt like any other
    table = table.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
    return Vectors(table, dim, blocks, known[2] or 1.0, known[3] or 0.0)


def to_every_block(queries: DataFrame, blocks: int) -> DataFrame:
    return queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def past_blocks(rows: DataFrame, queries: DataFrame, blocks: int, build: Callable, answer: Callable, schema: str) -> DataFrame:
    """answer(build(rows of a block), some queries of the block) for every block; both have columns block, id and vec, and others
    that are null on the other side. build sees a whole block (ROWS rows or somewhat more), answer at most PART queries."""
    both = rows.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    both = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, index = None, [], None
        for pdf in batches:
            for b, part in pdf.groupby("block", sort=False):
                if b != block:
                    block, held, index = b, [], None
                asks = part["asks"].to_numpy(bool)
                if not asks.all():
                    held.append(part[~asks])
                if asks.any() and held:
                    index, held = build(pd.concat(held)), []
                if index is not None:
                    part = part[asks]
                    for i in range(0, len(part), PART):
                        yield answer(index, part.iloc[i : i + PART])

    return both.mapInPandas(run, schema)


def matrix(vec: pd.Series) -> np.ndarray:
    return np.stack(vec.to_numpy()).astype(np.float64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids; all of them if there are fewer."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
