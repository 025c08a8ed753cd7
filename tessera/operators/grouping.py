"""Multisets, duplicates, dominance and order-based windows. Order is an explicit column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sweeps import Sweep


# -- multisets and duplicates ---------------------------------------------------------------------


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def bag_union(*bags: DataFrame, key: str = "value") -> DataFrame:
    """Counts of bags(key, n) added."""
    out = bags[0]
    for b in bags[1:]:
        out = out.unionByName(b)
    return out.groupBy(key).agg(F.sum("n").alias("n"))


def bag_map(bag: DataFrame, value: Column, key: str = "value") -> DataFrame:
    """Counts regrouped under a mapped value."""
    return bag.select(value.alias(key), "n").groupBy(key).agg(F.sum("n").alias("n"))


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """One row for each value seen more than once."""
    return df.groupBy(key).count().where("count > 1").select(key)


def later_copies(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Every copy but the first."""
    return _numbered(df, [key], [seq]).where("_n > 1").drop("_n")


def key_checks(df: DataFrame, col: str) -> DataFrame:
    """(is_key, is_constant) of a column."""
    return df.agg((F.count("*") == F.count_distinct(col)).alias("is_key"), (F.count_distinct(col) <= 1).alias("is_constant"))


def group_by_key(df: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """(key, members array in the order of seq)."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))), lambda x: x["v"]).alias("members"))


def unique_or_ambiguous(df: DataFrame, key: str, place: str) -> DataFrame:
    """(key, place, n): every place of every key, a row each, with the key's number of places; keys with n > 1 are ambiguous."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return df.select(key, place).join(n.where("n > 1"), key, "left").select(key, place, F.coalesce("n", F.lit(1)).alias("n"))


# -- splitting streams ----------------------------------------------------------------------------


def partition_by_class(df: DataFrame, cls: Column, names: list[str]) -> dict[str, DataFrame]:
    """The rows of each class; rows of no class are under "". Each frame scans df; classed() does with one pass."""
    c = df.withColumn("_class", cls)
    out = {n: c.where(F.col("_class") == n).drop("_class") for n in names}
    return out | {"": c.where(F.col("_class").isNull() | ~F.col("_class").isin(*names)).drop("_class")}


def classed(df: DataFrame, cls: Column, names: list[str]) -> DataFrame:
    """df with class, one of names or "" for rows of none: the partition in one pass, to be written by class or grouped on."""
    return df.withColumn("class", F.when(cls.isin(*names), cls).otherwise(""))


def partition_keys(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is, and is not, in keys(key)."""
    k = keys.select(key).distinct()
    return df.join(k, key, "left_semi"), df.join(k, key, "left_anti")


def find_mentions(df: DataFrame, name: Column, mentions: Column, substrings: list[str], groups: list[list[str]]) -> DataFrame:
    """Rows whose name holds all substrings and whose mentions meet every identifier group."""
    cond = F.lit(True)
    for s in substrings:
        cond = cond & F.contains(name, F.lit(s))
    for g in groups:
        cond = cond & F.arrays_overlap(mentions, F.array(*map(F.lit, g)))
    return df.where(cond)


def drop_if_accompanied(df: DataFrame, group: str, low_value: Column) -> DataFrame:
    """Drop low-value rows of groups that have other rows."""
    others = F.max(F.when(low_value, 0).otherwise(1)).over(W.partitionBy(group))
    return df.withColumn("_o", others).where(~low_value | (F.col("_o") == 0)).drop("_o")


# -- order-based ----------------------------------------------------------------------------------


def _numbered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def first_per_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key, as an aggregate: no sort of a hot key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(key, "r.*").select(*df.columns)


def first_and_later(df: DataFrame, key: str, seq: str) -> DataFrame:
    """df with is_first."""
    return _numbered(df, [key], [seq]).withColumn("is_first", F.col("_n") == 1).drop("_n")


def favourite_per_key(df: DataFrame, key: str, fav: str, seq: str) -> DataFrame:
    """The row of the least fav of each key, ties to the first."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(fav, seq)).alias("r")).select(key, "r.*").select(*df.columns)


def consecutive_check(df: DataFrame, group: str, seq: str, relation) -> DataFrame:
    """(group, holds): relation(previous row, this row) on every adjacent pair; the columns of the previous row are
    given as a struct."""
    d = Sweep(df, seq, group).preceding("_p", F.struct(*df.columns), (seq,)).df
    return d.groupBy(group).agg(F.coalesce(F.bool_and(F.when(F.col("_p").isNotNull(), relation(F.col("_p")))), F.lit(True)).alias("holds"))


def runs(df: DataFrame, group: str, seq: str, same) -> DataFrame:
    """df with run (from 1): a new one whenever same(previous row) fails."""
    sweep = Sweep(df, seq, group).preceding("_p", F.struct(*df.columns), (seq,))
    sweep.df = sweep.df.withColumn("_s", F.when(F.col("_p").isNotNull() & F.coalesce(same(F.col("_p")), F.lit(False)), 0).otherwise(1)).drop("_p")
    return sweep.running("run", F.col("_s"), (seq,)).rows().select(*df.columns, "run")


def chunks(df: DataFrame, group: str, seq: str, n: int) -> DataFrame:
    """df with chunk (from 0): pieces of n rows."""
    d = Sweep(df, seq, group).running("_n", F.lit(1), (seq,)).df
    return d.select(*df.columns, F.expr(f"(_n - 1) div {n}").alias("chunk"))


def split_when(df: DataFrame, group: str, seq: str, separator: Column) -> DataFrame:
    """df with segment (from 0): its number among the segments between separator rows; separators belong to the segment before them
    and are flagged is_separator, so empty segments can be told."""
    sep = F.when(separator, 1).otherwise(0)
    d = Sweep(df, seq, group).running("segment", sep, (seq,)).df
    return d.select(*df.columns, (F.col("segment") - sep).alias("segment"), separator.alias("is_separator"))


def bill_switches(df: DataFrame, stream: str, ts: str, account: str) -> DataFrame:
    """(stream, account, ms): each switch bills the time up to the next one to its account; null accounts bill nothing, and so
    does the last, still open one."""
    d = Sweep(df, ts, stream).following("_next", F.col(ts), (ts, account)).df
    ms = F.unix_millis("_next") - F.unix_millis(F.col(ts))
    return d.withColumn("_ms", ms).where(F.col(account).isNotNull() & F.col("_ms").isNotNull()).groupBy(stream, account).agg(F.sum("_ms").alias("ms"))


def find_first(df: DataFrame, group: str, seq: str, cond: Column) -> DataFrame:
    """The first row by seq of each group that cond holds for."""
    rest = [c for c in df.columns if c != group]
    return df.where(cond).groupBy(group).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(group, "r.*").select(*df.columns)


def prefix_and_suffix_runs(df: DataFrame, group: str, seq: str, cond: Column) -> DataFrame:
    """df with in_prefix (this and all before satisfy cond), in_suffix (this and all after do) and from_end (1 for the
    last row, so that "drop the last n" is from_end > n)."""
    sweep = Sweep(df, seq, group).all_hold("in_prefix", cond, (seq,)).all_hold("in_suffix", cond, (seq,), back=True)
    return sweep.running("from_end", F.lit(1), (seq,), back=True).rows().select(*df.columns, "in_prefix", "in_suffix", "from_end")


def align(a: DataFrame, b: DataFrame, seq: str) -> DataFrame:
    """(pos, left, right): a and b (distinct seq, value) paired by position, with both tails. Positions are dense ids, so no
    task sees a whole table."""
    from .graph import dense_ids

    n = lambda d, name: d.join(dense_ids(d, seq, "_i"), seq).select((F.col("_i") + 1).alias("pos"), F.col("value").alias(name))
    return n(a, "left").join(n(b, "right"), "pos", "full")


def align_groups(a: DataFrame, b: DataFrame, group: str, seq: str) -> DataFrame:
    """align() within each group."""
    n = lambda d, name: Sweep(d, seq, group).running("pos", F.lit(1), (seq,)).df.select(group, "pos", F.col("value").alias(name))
    return n(a, "left").join(n(b, "right"), [group, "pos"], "full")


# -- dominance ------------------------------------------------------------------------------------


def pointwise(a: Column, b: Column) -> Column:
    """LT LE EQ GE GT Any of two arrays of equal length; Any if lengths differ. Strict everywhere is LT (GT)."""
    z = F.zip_with(a, b, lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0))
    every = lambda f: F.forall(z, f)
    return F.when(F.size(a) != F.size(b), "Any").when(every(lambda d: d == 0), "EQ").when(every(lambda d: d < 0), "LT").when(every(lambda d: d > 0), "GT").when(every(lambda d: d <= 0), "LE").when(every(lambda d: d >= 0), "GE").otherwise("Any")


def inclusion(a: Column, b: Column) -> Column:
    """LT EQ GT Any of two sets."""
    up, down = F.size(F.array_except(a, b)) == 0, F.size(F.array_except(b, a)) == 0
    return F.when(up & down, "EQ").when(up, "LT").when(down, "GT").otherwise("Any")


def skyline(df: DataFrame, cols: list[str], seq: str) -> DataFrame:
    """Rows that no other row dominates (less is better in every column); of equal rows the first by seq stays.

    Each partition keeps its own skyline, in batches; what is left is compared block by block (_dominated)."""
    from ..sources.tables import materialize

    small = materialize(_local_skylines(df, cols, seq).withColumn("_id", F.monotonically_increasing_id()))
    return small.join(_dominated(small, small, cols, seq), "_id", "left_anti").drop("_id")


def _local_skylines(df: DataFrame, cols: list[str], seq: str | None = None) -> DataFrame:
    """The skyline of every partition."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            pdf = pdf.assign(_sum=pdf[cols].sum(axis=1)).sort_values(["_sum", *[seq] * bool(seq)]).drop(columns="_sum")  # winners come early
            x, keep = pdf[cols].to_numpy(), []
            for i in range(len(x)):
                if not keep or not (x[keep] <= x[i]).all(1).any():
                    keep.append(i)
            held = pdf.iloc[keep]
        if held is not None:
            yield held

    return df.mapInPandas(local, df.schema)


#: Rows of a block that is compared with another.
BLOCK = 4096


def _dominated(a: DataFrame, b: DataFrame, cols: list[str], seq: str | None = None, strict: bool = True) -> DataFrame:
    """(_id) of the rows of a(_id, ...) that some row of b is at most equal to in all columns and less in one; equal rows count too if they are
    before by seq, or at all if strict is false. Both sides, written tables, are dealt into blocks by hash, and each pair of
    blocks is a task's, so none holds more than two blocks and nothing is broadcast."""
    blocks = lambda d: max(1, -(-d.count() // BLOCK))
    n, m = blocks(a), blocks(b)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    more = [seq] if seq else []
    left = a.select("_id", *cols, *more, F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int").alias("_i"), every(m).alias("_j")).toDF("_id", *cols, *more, "_i", "_j")
    right = b.select(*cols, *more, every(n).alias("_i"), F.pmod(F.xxhash64(*cols, *more), F.lit(m)).cast("int").alias("_j")).toDF(*cols, *more, "_i", "_j")

    def beaten(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p, q = x[cols].to_numpy(), y[cols].to_numpy()
        out = np.zeros(len(p), bool)
        for i in range(0, len(p) if len(q) else 0, 64):
            le = (q[None] <= p[i : i + 64, None]).all(2)
            eq = (q[None] == p[i : i + 64, None]).all(2)
            same = eq if not strict else eq & (y[seq].to_numpy()[None] < x[seq].to_numpy()[i : i + 64, None]) if seq else eq & False
            out[i : i + 64] = ((le & ~eq) | same).any(1)
        return x.loc[out, ["_id"]]

    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(beaten, "_id long").distinct()


def compare_skylines(new: DataFrame, old: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new items that survive, old items that survive): the new must not be dominated by or equal to an old one, the old not be strictly
    dominated by a new one. Only the skylines of either side's partitions meet the other side."""
    from ..sources.tables import materialize

    n, o = (materialize(d.withColumn("_id", F.monotonically_increasing_id())) for d in (new, old))
    best_n, best_o = (materialize(_local_skylines(d.select(*cols), cols)) for d in (n, o))
    return n.join(_dominated(n, best_o, cols, strict=False), "_id", "left_anti").drop("_id"), o.join(_dominated(o, best_n, cols), "_id", "left_anti").drop("_id")
