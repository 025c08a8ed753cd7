"""Importance resampling towards a target distribution, drawn without replacement by an exact cutoff.

Features are runs of words, hashed to buckets. What a bucket's share in the target gains on its share in the
corpus is one number, so all gains are one array, and a document's weight is a sum of array entries. A
Gumbel variable, made of the document's id by a hash, is added to the weight; the highest scores are
the sample.

The lowest score drawn is found by weighted median of medians. Every partition of the keys names the median of
those that are left in it and their number. The median of these medians, weighted by the numbers, has at
least a quarter of all that is left on either side, so each round discards a guaranteed fraction,
until the pivot is the cutoff key itself. Only the winners are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, materialize_counting, release
from .common import placed

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Between words; upper case is lowered after the cut.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What orders rows: smaller is better.
KEY = ("a", "b", "c", "rid")
SIDES = "side int, n long, a long, b long, c long, rid long"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all beyond ASCII, with A-Z lower-cased; none for null."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")
    return F.transform(found, lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, UPPER, LOWER)).otherwise(w))


def buckets_of(words: Column, longest: int = RUN, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to longest consecutive words, repeats included."""

    def runs(k: int) -> Column:
        at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, k), " "))

    return F.transform(F.concat(words, *map(runs, range(2, longest + 1))), lambda f: F.pmod(F.crc32(f), F.lit(buckets)).cast("int"))


def gains(corpus: DataFrame, target: DataFrame, text: str = "text", longest: int = RUN, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln(share in the target / share in the corpus)) of every bucket, each share with one added to the bucket and as many as there
    are buckets to the sum. Counts cover all texts; the driver gets one row a bucket."""
    counts = None
    for name, df in (("s", corpus), ("t", target)):
        own = df.select(words_of(F.col(text)).alias("words"))  # a column of its own: runs of words look into it again and again
        own = own.select(F.explode(buckets_of(F.col("words"), longest, buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))
        counts = own if counts is None else counts.join(own, "bucket", "full")
    counts = materialize(counts.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")))
    S, T = (x or 0.0 for x in counts.agg(F.sum("s"), F.sum("t")).first())
    gain = lambda s, t: F.floor(1000 * F.log(((t + 1) * (S + buckets)) / ((s + 1) * (T + buckets))))
    out = [counts.sparkSession.range(1).select(gain(F.lit(0.0), F.lit(0.0))).first()[0]] * buckets
    for bucket, value in counts.select("bucket", gain(F.col("s"), F.col("t"))).collect():
        out[bucket] = value
    return out


def scored(docs: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text", longest: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    array = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    out = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    out = out.select("doc_id", F.size("words").cast("long").alias("n_words"), buckets_of(F.col("words"), longest, len(gain)).alias("buckets"))
    weight = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(array, b))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return out.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + noise)


# -- selection ------------------------------------------------------------------------------------


def _middle(columns: list[np.ndarray]) -> list[int]:
    """The lower median of the rows of these columns, compared from the first column on."""
    at, out = (len(columns[0]) - 1) // 2, []
    keep = np.arange(len(columns[0]))
    for column in columns:
        own = column[keep]
        x = np.partition(own, at)[at]
        at -= int((own < x).sum())
        keep = keep[own == x]
        out.append(int(x))
    return out


def _sides(pivot: tuple | None):
    """For a partition of keys: number and median of the keys better than the pivot (side -1) and worse (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy() for i in range(len(KEY))] for b in batches]
        columns = [np.concatenate(x) for x in zip(*parts)] or [np.zeros(0, np.int64)] * len(KEY)
        less, equal = np.zeros(len(columns[0]), bool), np.ones(len(columns[0]), bool)
        for column, x in zip(columns, pivot or ()):
            less |= equal & (column < x)
            equal &= column == x
        sides = ((-1, less), (1, ~less & ~equal)) if pivot else ((1, equal),)
        found = [(side, int(keep.sum()), *_middle([c[keep] for c in columns])) for side, keep in sides if keep.any()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), [pa.int32()] + [pa.int64()] * 5)], names=["side", "n", *KEY])

    return run


def _weighted_median(medians: list[tuple]) -> tuple:
    """medians: (number, key); the first key with half of all numbers up to it."""
    upto, half = 0, sum(n for n, _ in medians)
    for n, key in sorted(medians, key=lambda x: x[1]):
        upto += n
        if 2 * upto >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int) -> tuple | None:
    """The k-th smallest row of keys, a written table of the non-null columns KEY (rid makes them all different); None if there are fewer.

    A round reads what is left and gathers two rows a partition; what is left is written anew when it has shrunk to a quarter. A task
    holds one partition as the reader cuts it (spark.sql.files.maxPartitionBytes)."""
    key = F.struct(*KEY)
    literal = lambda p: F.struct(*[F.lit(x).cast("bigint").alias(c) for x, c in zip(p, KEY)])

    def look(rest: DataFrame, pivot: tuple | None) -> dict[int, list[tuple]]:
        out: dict[int, list[tuple]] = {-1: [], 1: []}
        for r in rest.select(*KEY).mapInArrow(_sides(pivot), SIDES).collect():  # two rows a partition
            out[r["side"]].append((r["n"], tuple(r[c] for c in KEY)))
        return out

    written = rest = keys
    left = look(rest, None)[1]
    held = total = sum(n for n, _ in left)
    if k < 1 or k > total:
        return None
    while True:
        pivot = _weighted_median(left)
        found = look(rest, pivot)
        better = sum(n for n, _ in found[-1])
        if k == better + 1:
            break
        if k <= better:
            left, rest = found[-1], rest.where(key < literal(pivot))
        else:
            k, left, rest = k - better - 1, found[1], rest.where(key > literal(pivot))
        total = sum(n for n, _ in left)
        if total * 4 <= held:
            rest, held = materialize(rest), total
            if written is not keys:
                release(written)
            written = rest
    if written is not keys:
        release(written)
    return pivot


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score and rank (from 1, the sample in order of falling score, ties to
    smaller doc_id; null: not drawn).

    Of the N rows with least_words words or more, floor(percent N / 100) are drawn. Null texts have no features (weight 0) and are never drawn unless least_words is 0; a
    null id is hashed as an empty one and loses ties; repeated rows are drawn one by one, equal ids of equal score by fewer features. Empty
    tables give no rows; an empty target still has gains. Other columns are ignored."""
    gain = gains(docs, target, text, longest, buckets)
    rows = scored(docs, gain, doc_id, text, longest, seed).withColumn("rid", F.monotonically_increasing_id())
    rows, n = materialize_counting(rows, F.col("n_words") >= least_words)
    eligible = F.col("n_words") >= least_words
    last = (1 << 63) - 1
    keyed = rows.withColumns({"a": -F.col("score"), "b": F.coalesce(F.col("doc_id").cast("long"), F.lit(last)), "c": F.col("n_features")})
    keys = materialize(keyed.where(eligible).select(*KEY))
    end = cutoff(keys, percent * n // 100)
    release(keys)
    out = ["doc_id", "n_features", "weight", "score"]
    if end is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = eligible & (F.struct(*KEY) <= F.struct(*[F.lit(x).cast("bigint").alias(c) for x, c in zip(end, KEY)]))
    winners = placed(keyed.where(drawn), [F.col(c) for c in KEY], "rank").select(*out, "rank")
    return winners.unionByName(keyed.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
