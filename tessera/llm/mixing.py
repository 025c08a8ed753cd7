"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size says how often each of its documents is taken: the whole part surely, and once more with
the fraction as probability. These fractional inclusion probabilities are a point of a cube. The flight moves it through
the null space of the constraints, which are the source's total of words and of documents: any three documents have a
direction that keeps both (two suffice if their sizes are equal), and the point goes along it, one way or the other with the odds
that keep each probability as it is on average, until a document is in or out. At most two documents of different sizes stay fractional.

Documents fly in blocks, in tasks; what stays of many blocks of a source flies on, level by level, until one block a
source is left. The landing takes the last two in part: as many of their words as their probabilities say,
which keeps the total of words. Equal rows fly as one, so no row is repeated often enough to fill a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialize, release
from .common import placed

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
WORD = r"[^ \t-\r]+"
#: Documents of a block, blocks whose rest flies on together, and parts in which a source meets its target.
BLOCK, FAN, SALT = 20_000, 5_000, 64
#: Equal rows that a task makes of one at a time.
COPIES = 100_000
#: Probabilities this near to 0 or 1 are that.
EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for sizes(source, source_size), one row a source: share of all words, by weights that repeat in the
    order of the sources by code point, null last; no target above most times its source's size, the excess goes to the others by weight, until none is
    above. Needs no more of a driver than sums."""
    at = placed(sizes, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    at = materialize(at.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * float(most)).alias("_cap")))
    total = (at.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    above = F.lit(False)
    while True:
        capped, n, open_weight = at.agg(F.sum(F.when(above, F.col("_cap"))), F.count_if(above), F.sum(F.when(~above, F.col("_w")))).first()
        if n == full or not open_weight:
            break
        full, level = n, max(0.0, total - (capped or 0.0)) / open_weight
        above = F.col("_cap") <= F.lit(level) * F.col("_w")
    return at.select("source", "source_size", F.least("_cap", F.lit(level) * F.col("_w")).alias("target"))


def fly(sizes: np.ndarray, chances: np.ndarray, seed: list[int]) -> np.ndarray:
    """Chances moved to 0 and 1, all but two at most, with the sums of the chances and of sizes times chances kept."""
    rng = np.random.default_rng(seed)
    p, size = chances.tolist(), sizes.tolist()
    active: list[int] = []
    draws: list[float] = []
    for nxt in [*range(len(p)), None]:
        if nxt is not None:
            if EPS < p[nxt] < 1 - EPS:
                active.append(nxt)
            else:
                p[nxt] = float(p[nxt] > 0.5)
        while True:
            pair = next(((i, j) for k, i in enumerate(active) for j in active[k + 1 :] if size[i] == size[j]), None)
            if pair:
                ways = [(pair[0], 1.0), (pair[1], -1.0)]
            elif len(active) == 3:
                a, b, c = active
                largest = float(max(abs(size[b] - size[c]), abs(size[c] - size[a]), abs(size[a] - size[b])))
                ways = [(a, (size[b] - size[c]) / largest), (b, (size[c] - size[a]) / largest), (c, (size[a] - size[b]) / largest)]
            else:
                break
            up = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in ways)
            down = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in ways)
            if not draws:
                draws = rng.random(1024).tolist()
            step = up if draws.pop() * (up + down) < down else -down
            ended = min(ways, key=lambda w: min(p[w[0]] + step * w[1], 1 - p[w[0]] - step * w[1]))[0]
            for i, u in ways:
                p[i] += step * u
            for i, _ in ways:
                if i == ended or not EPS < p[i] < 1 - EPS:
                    p[i] = float(p[i] > 0.5)
                    active.remove(i)
    return np.array(p)


def _flight(key: tuple, table: pa.Table) -> pa.Table:
    order = [("size", "descending"), ("doc_id", "ascending")]
    table = table.sort_by(order)  # long documents first, so that what stays is short
    moved = fly(table["size"].to_numpy(), table["p"].to_numpy(), [int(x.as_py()) for x in key])
    return table.set_column(table.schema.get_field_index("p"), "p", pa.array(moved, pa.float64()))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, size (words), source_size, target and taken of every row: how many of the document's words the mix takes, repeats counted.

    Null texts have no words and none is taken; a null source is one like any other, as is an empty one; null ids stay; of repeated rows each is
    taken on its own. No document is taken more than most times. A source's taken words differ from its target by one at most (and by
    rounding, in floating point, of sums beyond 2**53). Reruns agree, however the table is split: all draws are seeded by numbers of the source and block, and
    blocks are made by hashes of rows. An empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    equal = materialize(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
    sizes = equal.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("_n"))
    sizes = materialize(sizes)
    found = targets(sizes.select("source", "source_size"), weights, share, most)
    # sources by number, each in SALT rows, so that a large source meets its target in as many tasks
    known = found.join(sizes.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumnsRenamed({"source": "_s", "salt": "_salt"})
    met = equal.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALT))).join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("salt") == F.col("_salt")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    # of equal rows, copies * p are in: the whole part surely, so one at most is open
    met = met.select("doc_id", "source", "size", "copies", "source_size", "target", "_n", rate.alias("rate")).withColumn("base", F.floor("rate"))
    met = met.withColumn("open", (F.col("rate") - F.col("base")) * F.col("copies")).withColumn("sure", F.floor("open"))
    met = met.withColumn("p", F.col("open") - F.col("sure")).withColumn("blocks", F.ceil(F.col("_n") / BLOCK).cast("long"))
    met = met.select("doc_id", "size", "copies", "source_size", "target", "base", "sure", "p", "blocks", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1)).alias("sid"))
    live = met.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("blocks")))
    done, level = [], 0
    while True:
        live = live.withColumn("level", F.lit(level))
        live = materialize(live.groupBy("sid", "level", "block").applyInArrow(_flight, live.schema))
        between = (F.col("p") > 0) & (F.col("p") < 1)
        if live.where(between & (F.col("blocks") > 1)).isEmpty():
            done.append(live)
            break
        done.append(live.where(~between | (F.col("blocks") <= 1)))
        live = live.where(between & (F.col("blocks") > 1)).withColumn("block", F.floor(F.col("block") / FAN)).withColumn("blocks", F.ceil(F.col("blocks") / FAN))
        level += 1
    flown = done[0]
    for more in done[1:]:
        flown = flown.unionByName(more)
    # copies of a row: sure ones once more, then the one that flew, then the others; very many copies are dealt out in parts first
    few, many = flown.where(F.col("copies") <= COPIES).withColumn("first", F.lit(0).cast("long")), flown.where(F.col("copies") > COPIES)
    many = many.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    flown = few.unionByName(many.repartition("doc_id", "size", "first"))
    flown = flown.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + COPIES, F.col("copies")) - 1)))
    extra = F.when(F.col("copy") < F.col("sure"), F.col("size")).when(F.col("copy") == F.col("sure"), F.round(F.col("p") * F.col("size")).cast("long")).otherwise(F.lit(0).cast("long"))
    return flown.select("doc_id", "size", "source_size", "target", (F.col("base") * F.col("size") + extra).cast("long").alias("taken"))
