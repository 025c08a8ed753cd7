"""Sweeps over the rows of a group in their order, of groups of any size.

A group of more than SPLIT rows is cut into PIECES by quantiles of the order column, each a window of its own; what a piece needs of
those before or behind it (the furthest end, a running sum, the next start) is one value for each piece, carried over. Orders by
numbers, dates and times can be cut, also as the first field of a struct; a group in the order of other values stays one window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialize

SPLIT, PIECES = 1_000_000, 64

BEFORE, UPTO = (W.unboundedPreceding, -1), (W.unboundedPreceding, 0)


def _place(df: DataFrame, at: str) -> Column | None:
    """The part of the order that pieces are cut by."""
    c, kind = F.col(at), df.schema[at].dataType
    while isinstance(kind, T.StructType) and kind.fields:
        c, kind = c[kind.fields[0].name], kind.fields[0].dataType
    return c if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) else None


class Sweep:
    """Rows whose groups (of the column grp) are swept in the order of the column at and others after it."""

    def __init__(self, df: DataFrame, at: str = "start", grp: str = "grp"):
        self.grp, place = grp, _place(df, at)
        big = None
        if place is not None:
            big = materialize(df.groupBy(grp).agg(F.count("*").alias("_n")).where(F.col("_n") > SPLIT).select(grp))  # one row for each SPLIT rows, at most
        if big is None or big.isEmpty():
            self.df, self.big = df.withColumn("_piece", F.lit(0)), None
            return
        cuts = df.join(big, grp, "left_semi").groupBy(grp).agg(F.percentile_approx(place, [i / PIECES for i in range(1, PIECES)]).alias("_cuts"))
        cuts = materialize(cuts)
        piece = F.size(F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda x: x < place))
        self.df, self.big = df.join(cuts, grp, "left").withColumn("_piece", piece).drop("_cuts"), big

    def by(self, *order) -> W:
        """The window of a row's own piece."""
        return W.partitionBy(self.grp, "_piece").orderBy(*order)

    def add(self, name: str, local: Column, total: Column, carried: Callable[[W], Column], combine: Callable[[Column, Column], Column], back: bool = False) -> Sweep:
        """A column: local is its value from the row's own piece, total what a piece passes on, carried(window over a group's pieces,
        from the last one if back) what arrives."""
        self.df = self.df.withColumn(name, local)
        if self.big is not None:
            t = self.df.join(self.big, self.grp, "left_semi").groupBy(self.grp, "_piece").agg(total.alias("_t"))
            t = t.select(self.grp, "_piece", carried(W.partitionBy(self.grp).orderBy(F.desc("_piece") if back else F.asc("_piece")).rowsBetween(*BEFORE)).alias("_c"))
            self.df = self.df.join(t, [self.grp, "_piece"], "left").withColumn(name, combine(F.col(name), F.col("_c"))).drop("_c")
        return self

    def furthest(self, name: str, value: Column, order: tuple, frame: tuple = BEFORE) -> Sweep:
        """The maximum over the rows before (or up to) each."""
        return self.add(name, F.max(value).over(self.by(*order).rowsBetween(*frame)), F.max(value), lambda w: F.max("_t").over(w), F.greatest)

    def running(self, name: str, value: Column, order: tuple, back: bool = False) -> Sweep:
        """The sum up to each row, or from it on."""
        way = [F.desc(c) if back else F.asc(c) for c in order]
        return self.add(name, F.sum(value).over(self.by(*way).rowsBetween(*UPTO)), F.sum(value), lambda w: F.sum("_t").over(w), lambda x, c: x + F.coalesce(c, F.lit(0)), back)

    def all_hold(self, name: str, cond: Column, order: tuple, back: bool = False) -> Sweep:
        """Whether cond holds for every row up to each, or from it on; nulls tell nothing."""
        way = [F.desc(c) if back else F.asc(c) for c in order]
        return self.add(name, F.bool_and(cond).over(self.by(*way).rowsBetween(*UPTO)), F.bool_and(cond), lambda w: F.bool_and("_t").over(w), lambda x, c: F.coalesce(x & c, x, c), back)

    def following(self, name: str, value: Column, order: tuple) -> Sweep:
        """The first value that is not null behind each row. In falling order it is the last one seen, so the frame only grows and
        every row is looked at once."""
        seen = lambda c: F.last(c, ignorenulls=True)
        back = [F.desc(c) for c in order]
        return self.add(name, seen(value).over(self.by(*back).rowsBetween(*BEFORE)), F.min_by(value, F.when(value.isNotNull(), F.struct(*order))), lambda w: seen("_t").over(w), F.coalesce, True)

    def preceding(self, name: str, value: Column, order: tuple) -> Sweep:
        """The value of the row before each."""
        return self.add(name, F.lag(value).over(self.by(*order)), F.max_by(value, F.struct(*order)), lambda w: F.last("_t").over(w), F.coalesce)

    def rows(self) -> DataFrame:
        return self.df.drop("_piece")
