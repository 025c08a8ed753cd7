"""Half-open intervals (grp, start, end) and annotations on them.

Sweeps (sweeps.py) run in a window for each group, or for each piece of a very large one. The overlap join puts intervals in bins, so a huge group is dealt over many tasks there too.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .sweeps import UPTO, Sweep


def overlap_join(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of a(grp, start, end, ...) and b (columns prefixed b_) whose intervals overlap; touching doesn't count.

    Bins of width: an interval goes to each bin it meets, and a pair is given by the bin of the later start only."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    left = a.where("start < end").withColumn("_bin", bins("start", "end"))
    right = b.where("start < end").select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("_bbin", bins("b_start", "b_end"))
    hit = (F.col("grp") == F.col("b_grp")) & (F.col("_bin") == F.col("_bbin")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    once = F.floor(F.greatest("start", "b_start") / width) == F.col("_bin")
    return left.join(right, hit & once).drop("_bin", "_bbin", "b_grp")


def overlap_exists(a: DataFrame, b: DataFrame) -> DataFrame:
    """(grp): groups in which some interval of a overlaps some interval of b. A sweep: an interval overlaps an
    earlier-starting one of the other side if it starts before the furthest end there."""
    both = a.select("grp", "start", "end", F.lit(0).alias("s")).union(b.select("grp", "start", "end", F.lit(1).alias("s"))).where("start < end")
    order = ("start", "s", "end")
    sweep = Sweep(both)
    for side in (0, 1):
        sweep.furthest(f"f{side}", F.when(F.col("s") == side, F.col("end")), order)
    return sweep.df.where("(s = 1 and start < f0) or (s = 0 and start < f1)").select("grp").distinct()


def fuse(ranges: DataFrame) -> DataFrame:
    """The least intervals that cover these; overlapping and touching ones merge. Empty intervals vanish."""
    return _fused(Sweep(ranges.where("start < end").select("grp", "start", "end")))


def _fused(sweep: Sweep) -> DataFrame:
    sweep.furthest("_far", F.col("end"), ("start", "end"))
    opens = F.when(F.col("_far").isNull() | (F.col("start") > F.col("_far")), F.col("start"))
    run = sweep.furthest("_run", opens, ("start", "end"), UPTO).df  # told by its first start
    return run.groupBy("grp", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def _cover(a: DataFrame, b: DataFrame) -> Sweep:
    """Segments between neighbouring ends, with how many intervals of either side cover them."""
    ev = lambda d, x, s: d.where("start < end").select("grp", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e")).select("grp", "e.at", (F.col("e.d") * x).alias("da"), (F.col("e.d") * s).alias("db"))
    e = ev(a, 1, 0).union(ev(b, 0, 1)).groupBy("grp", "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    sweep = Sweep(e, "at").running("in_a", F.col("da"), ("at",)).running("in_b", F.col("db"), ("at",)).following("end", F.col("at"), ("at",))
    sweep.df = sweep.df.withColumnRenamed("at", "start").where("end is not null")
    return sweep


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions in a and not in b, as separated intervals."""
    sweep = _cover(a, b)  # segments are in the same order, so the same pieces serve
    sweep.df = sweep.df.where("in_a > 0 and in_b = 0").select("grp", "_piece", "start", "end")
    return _fused(sweep)


#: Stand-ins for unbounded ends of U5 covers.
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def _finite(r: DataFrame) -> DataFrame:
    return r.select("grp", F.coalesce("start", F.lit(LOWEST)).alias("start"), F.coalesce("end", F.lit(HIGHEST)).alias("end"))


def _rays(r: DataFrame) -> DataFrame:
    return r.select("grp", F.when(F.col("start") != LOWEST, F.col("start")).alias("start"), F.when(F.col("end") != HIGHEST, F.col("end")).alias("end"))


def unbounded_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of integer sets whose null start or end means no bound."""
    return _rays(fuse(_finite(a).union(_finite(b))))


def unbounded_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _rays(subtract(_finite(a), _finite(b)))


def unbounded_member(points: DataFrame, r: DataFrame) -> DataFrame:
    """points(grp, pos, ...) that lie in the set. A merge: a point lies in it if the furthest end of what starts at or before it is behind it."""
    rest = F.struct(*[F.col(c) for c in points.columns])
    none = F.lit(None).cast(points.select(rest.alias("r")).schema["r"].dataType)
    both = fuse(_finite(r)).select("grp", F.col("start").alias("at"), "end", none.alias("_r"))
    both = both.union(points.select("grp", F.col("pos").alias("at"), F.lit(None).cast("long").alias("end"), rest.alias("_r")))
    far = Sweep(both, "at").furthest("_far", F.col("end"), ("at", F.col("_r").isNotNull())).df
    return far.where("_r is not null and at < _far").select("_r.*")


def overlay(layers: DataFrame, width: int = 4096) -> DataFrame:
    """(grp, start, end, labels): segments of layers(grp, start, end, seq, value) split at every boundary, with the covering values,
    the highest seq (the newest) first. Equal neighbours stay apart. width: that of overlap_join's bins."""
    r = layers.where("start < end")
    cuts = r.select("grp", F.explode(F.array("start", "end")).alias("at")).distinct()
    seg = Sweep(cuts, "at").following("end", F.col("at"), ("at",)).df.select("grp", F.col("at").alias("start"), "end").where("end is not null")
    cover = overlap_join(seg, r.select("grp", "start", "end", "seq", "value"), width)
    return cover.groupBy("grp", "start", "end").agg(F.transform(F.sort_array(F.collect_list(F.struct("b_seq", "b_value")), False), lambda x: x["b_value"]).alias("labels"))


def expand(ranges: DataFrame) -> DataFrame:
    """One row for each position."""
    rest = [c for c in ranges.columns if c not in ("start", "end")]
    return ranges.where("start < end").select(*rest, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))


#: Positions of a piece in which runs are made.
STRETCH = 65_536


def coalesce_positions(positions: DataFrame) -> DataFrame:
    """(grp, start, end, value): consecutive positions(grp, pos, value) of equal value become one interval; repeated positions count once.

    Positions are cut into stretches, and each stretch makes its own runs, so a large group is spread over many tasks. Only runs that
    touch a border of their stretch can go on in the next one; these, two a stretch at most, are fused."""
    piece = W.partitionBy("grp", "value", "_stretch").orderBy("pos")
    p = positions.withColumn("_stretch", F.floor(F.col("pos") / STRETCH))
    runs = p.withColumn("_run", F.col("pos") - F.dense_rank().over(piece)).groupBy("grp", "value", "_stretch", "_run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    runs = materialize(runs.withColumn("_border", (F.col("start") == F.col("_stretch") * STRETCH) | (F.col("end") == (F.col("_stretch") + 1) * STRETCH)))
    border = fuse(runs.where("_border").select(F.struct("grp", "value").alias("grp"), "start", "end"))
    return runs.where("not _border").select("grp", "start", "end", "value").union(border.select("grp.grp", "start", "end", "grp.value"))


def coalesce_ranges(ranges: DataFrame) -> DataFrame:
    """coalesce_positions(expand(ranges)) for ranges(grp, start, end, value), without a row for each position: a run of positions of
    equal value is made of ranges that overlap or touch."""
    runs = fuse(ranges.select(F.struct("grp", "value").alias("grp"), "start", "end"))
    return runs.select("grp.grp", "start", "end", "grp.value")


def covering_range(ranges: DataFrame) -> DataFrame:
    return ranges.where("start < end").groupBy("grp").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def split_at(ranges: DataFrame, at: Column) -> DataFrame:
    """Rows with side 'before' or 'after'; an interval over the point is cut in two."""
    rest = [c for c in ranges.columns if c not in ("start", "end")]
    low, high = F.least(F.col("end"), at), F.greatest(F.col("start"), at)
    pieces = F.array(F.struct(F.lit("before").alias("side"), F.col("start").alias("start"), low.alias("end")), F.struct(F.lit("after").alias("side"), high.alias("start"), F.col("end").alias("end")))
    return ranges.select(*rest, F.explode(pieces).alias("_p")).select(*rest, "_p.*").where("start < end")


def inside_and_outside(ranges: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows with inside true (clipped to [low, high)) or false (the rest, in up to two pieces)."""
    rest = [c for c in ranges.columns if c not in ("start", "end")]
    s, e = F.col("start"), F.col("end")
    piece = lambda i, a, b: F.struct(F.lit(i).alias("inside"), a.alias("start"), b.alias("end"))
    pieces = F.array(piece(False, s, F.least(e, low)), piece(True, F.greatest(s, low), F.least(e, high)), piece(False, F.greatest(s, high), e))
    return ranges.select(*rest, F.explode(pieces).alias("_p")).select(*rest, "_p.*").where("start < end")


def fuse_per_line(ranges: DataFrame) -> DataFrame:
    """Merge neighbours (by start) where one ends on the line on which the next starts: ranges(grp, start, end, line_start, line_end)."""
    sweep = Sweep(ranges.select("grp", "start", "end", "line_start", "line_end")).preceding("_line", F.col("line_end"), ("start", "end"))
    run = sweep.running("_run", F.when(F.col("_line") == F.col("line_start"), 0).otherwise(1), ("start", "end")).df
    return run.groupBy("grp", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end")).drop("_run")


def violations(ranges: DataFrame) -> DataFrame:
    """(grp, start, end, problem): empty intervals, and neighbours by start that overlap or only touch."""
    nxt = F.col("_next")
    problem = F.when(F.col("start") >= F.col("end"), "empty").when(nxt < F.col("end"), "overlap").when(nxt == F.col("end"), "touch")
    found = Sweep(ranges.select("grp", "start", "end")).following("_next", F.col("start"), ("start", "end")).df
    return found.withColumn("problem", problem).where("problem is not null").select("grp", "start", "end", "problem")


def merge_payloads(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One payload for each key from rows(aspect, others array, note, flag, site): the first aspect by seq, the union of others,
    different notes under each other with a rule between, flag if any, the first site."""
    o = F.struct(F.col(seq).alias("s"), "aspect", "others", "note", "flag", "site")
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(o)).alias("a"))
    first = lambda f: F.get(F.filter(F.transform("a", lambda x: x[f]), lambda x: x.isNotNull()), 0)
    notes = F.array_distinct(F.filter(F.transform("a", lambda x: x["note"]), lambda x: x.isNotNull()))
    return g.select(*keys, first("aspect").alias("aspect"), F.sort_array(F.array_distinct(F.flatten(F.transform("a", lambda x: F.coalesce(x["others"], F.array().cast("array<string>")))))).alias("others"), F.when(F.size(notes) > 0, F.array_join(notes, "\n----\n")).alias("note"), F.exists("a", lambda x: F.coalesce(x["flag"], F.lit(False))).alias("flag"), first("site").alias("site"))


def token_stream(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(grp, pos, token, tag): docs(grp, text) cut along non-overlapping spans(grp, start, end, tag) of positions from 1; text
    between spans has a null tag. Neighbouring equal tags are one token."""
    spans = materialize(spans.where("start < end").select("grp", "start", "end", "tag"))
    whole = docs.where(F.length("text") > 0).select("grp", F.lit(1).cast("long").alias("start"), (F.length("text") + 1).cast("long").alias("end"))
    gaps = subtract(whole, spans).withColumn("tag", F.lit(None).cast("string"))
    parts = spans.unionByName(gaps)
    # the cuts of a text come together once, and the text is sliced in one pass
    cuts = parts.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("start", "end", "tag"))).alias("c"))
    opens = lambda x, i: (i == 0) | ~F.get("c", i - 1)["tag"].eqNullSafe(x["tag"]) | (F.get("c", i - 1)["end"] != x["start"])
    firsts = cuts.select("grp", F.filter("c", opens).alias("r"), F.col("c")[F.size("c") - 1]["end"].alias("stop"))

    @F.pandas_udf("array<string>")
    def sliced(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([[t[a - 1 : b - 1] for a, b in zip(s.tolist(), [*s[1:].tolist(), stop])] for t, s, stop in zip(texts, starts, stops)])

    tokens = firsts.join(docs, "grp").select("grp", "r", sliced("text", F.transform("r", lambda x: x["start"]), "stop").alias("t"))
    return tokens.select("grp", F.explode(F.arrays_zip("r", "t")).alias("x")).select("grp", F.col("x.r.start").alias("pos"), F.col("x.t").alias("token"), F.col("x.r.tag").alias("tag"))


def link_target(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """rows(site, ...) with href: the definition's file, URL-encoded, and "#position" unless the position is 1 or less; null
    without a definition(site, file, pos)."""
    d = definitions.select("site", "file", F.col("pos").alias("_pos"))
    name = F.replace(F.url_encode("file"), F.lit("+"), F.lit("%20"))
    href = F.when(F.col("_pos") > 1, F.concat(name, F.lit("#"), F.col("_pos").cast("string"))).otherwise(name)
    return rows.join(d, "site", "left").withColumn("href", href).drop("file", "_pos")


def ordered_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(grp, side, start, end, other_start, other_end): a and b merged by (start, end, a first); each item that overlaps the
    next item of the other side in this order is a conflict."""
    both = a.select("grp", "start", "end", F.lit(0).alias("side")).union(b.select("grp", "start", "end", F.lit(1).alias("side")))
    sweep = Sweep(both)
    for side in (0, 1):
        sweep.following(f"n{side}", F.when(F.col("side") == side, F.struct("start", "end")), ("start", "end", "side"))
    both = sweep.df.withColumn("o", F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")))
    return both.where("o.start < end and start < o.end").select("grp", "side", "start", "end", F.col("o.start").alias("other_start"), F.col("o.end").alias("other_end"))
