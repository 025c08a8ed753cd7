"""Sparse matrices in coordinate form: matrix(i, j, v), indices from 1, zeros not stored, sizes as literals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semiring import Semiring

Size = tuple[int, int]


def from_lists(rows: DataFrame, i: str, values: str) -> DataFrame:
    """From one array a row; zeros dropped."""
    return rows.select(F.col(i).alias("i"), F.posexplode(values).alias("_p", "v")).select("i", (F.col("_p") + 1).cast("long").alias("j"), "v").where("v <> 0")


def to_sparse_rows(m: DataFrame) -> DataFrame:
    """(i, cells map of j to v)."""
    return m.groupBy("i").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("j", "v")))).alias("cells"))


def to_dense_rows(m: DataFrame, cols: int, zero: Column) -> DataFrame:
    """(i, cells array of cols values) of the rows that have a non-zero."""
    return to_sparse_rows(m).select("i", F.transform(F.sequence(F.lit(1).cast("long"), F.lit(cols).cast("long")), lambda j: F.coalesce(F.try_element_at("cells", j), zero)).alias("cells"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def diagonal(m: DataFrame, size: Size, zero: Column) -> DataFrame:
    """(i, v) for 1 to min(rows, cols), zeros filled."""
    every = m.sparkSession.range(1, min(size) + 1).withColumnRenamed("id", "i")
    return every.join(m.where("i = j").select("i", "v"), "i", "left").select("i", F.coalesce("v", zero).alias("v"))


def map_non_zeros(m: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return m.select("i", "j", f(F.col("v")).alias("v")).where("v <> 0")


def map_diagonal(m: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return m.select("i", "j", F.when(F.col("i") == F.col("j"), f(F.col("v"))).otherwise(F.col("v")).alias("v")).where("v <> 0")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pointwise on the union of cells; the size is the pairwise maximum. Cells that cancel go."""
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")


def intersect_with(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Pointwise on shared cells; zeros may appear."""
    return a.join(b.withColumnRenamed("v", "_w"), ["i", "j"]).select("i", "j", f(F.col("v"), F.col("_w")).alias("v"))


def multiply(a: DataFrame, b: DataFrame, semiring: Semiring, zero: Column) -> DataFrame:
    """Semiring product; inner dimensions need not match."""
    left = a.select("i", F.col("j").alias("_k"), F.col("v").alias("_a"))
    right = b.select(F.col("i").alias("_k"), "j", F.col("v").alias("_b"))
    return left.join(right, "_k").groupBy("i", "j").agg(semiring.plus(semiring.times(F.col("_a"), F.col("_b"))).alias("v")).where(F.col("v") != zero)


#: Rows and columns of a block.
BLOCK = 256


def _blocks(m: DataFrame, row: str, col: str, name: str) -> DataFrame:
    """(row, col, name): the blocks of a matrix that hold a cell, each with its cells, BLOCK * BLOCK at most."""
    at = lambda c: F.floor((F.col(c) - 1) / BLOCK).cast("long")
    cell = F.struct(F.pmod(F.col("i") - 1, F.lit(BLOCK)).cast("int").alias("r"), F.pmod(F.col("j") - 1, F.lit(BLOCK)).cast("int").alias("c"), F.col("v").cast("long").alias("v"))
    return m.groupBy(at("i").alias(row), at("j").alias(col)).agg(F.collect_list(cell).alias(name))


def multiply_blocked(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of matrices of whole numbers (distinct cells), for dense ones: what multiply() gives under sums of products.

    Cells are gathered to blocks, blocks meet on the inner block index, and each pair of blocks is one numpy product in a task. A dense row or column is
    so cut into blocks, and no more than a block's cells come out of a pair, while a join of cells would make a row for every product. Sums
    beyond 64 bits wrap, as in numpy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for n in range(whole.num_rows):
                one = whole.slice(n, 1)
                left, right = (np.zeros((BLOCK, BLOCK), np.int64) for _ in range(2))
                for dense, name in ((left, "a"), (right, "b")):
                    cells = one.column(name).flatten()
                    r, c, v = (x.to_numpy(zero_copy_only=False) for x in cells.flatten())
                    dense[r, c] = v
                rows, inner, cols = np.flatnonzero(left.any(1)), np.flatnonzero(left.any(0) & right.any(1)), np.flatnonzero(right.any(0))
                x, y = left[np.ix_(rows, inner)], right[np.ix_(inner, cols)]
                exact = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, len(inner)) < 2**53
                out = (x.astype(np.float64) @ y.astype(np.float64)).astype(np.int64) if exact else x @ y
                r, c = np.nonzero(out)
                i, j = (one.column(k)[0].as_py() * BLOCK + 1 + at for k, at in (("bi", rows[r]), ("bj", cols[c])))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(out[r, c], pa.int64())], names=["i", "j", "v"])

    pairs = _blocks(a, "bi", "bk", "a").join(_blocks(b, "bk", "bj", "b"), "bk")
    return pairs.mapInArrow(run, "i long, j long, v long").groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")


def compare(a: DataFrame, b: DataFrame, size_a: Size, size_b: Size) -> DataFrame:
    """(result): LT LE EQ GE GT Any of two matrices of equal size, a cell only on the left counting as greater, only on the right as
    less. Some less and none greater is LE; LT if every cell of the union is less (GE, GT alike)."""
    cell = F.when(F.col("v").isNull(), -1).when(F.col("_w").isNull(), 1).when(F.col("v") < F.col("_w"), -1).when(F.col("v") > F.col("_w"), 1).otherwise(0)
    c = a.join(b.withColumnRenamed("v", "_w"), ["i", "j"], "full").agg(F.min(cell).alias("lo"), F.max(cell).alias("hi"))
    lo, hi = F.coalesce("lo", F.lit(0)), F.coalesce("hi", F.lit(0))
    same = F.lit(size_a == size_b)
    return c.select(F.when(~same, "Any").when((lo == 0) & (hi == 0), "EQ").when((lo == -1) & (hi == -1), "LT").when((lo == 1) & (hi == 1), "GT").when(hi <= 0, "LE").when(lo >= 0, "GE").otherwise("Any").alias("result"))
