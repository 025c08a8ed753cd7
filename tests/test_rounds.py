"""Iterative graph operators against plain Python, and what their rounds write and shuffle."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.semiring import MIN_PLUS
from tessera.operators import chains, grouping, intervals, paths
from tessera.sources import tables


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, label long")


def reach_of(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = set()
    for s in out:
        stack, seen = [s], set()
        while stack:
            for y in out.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        found |= {(s, y) for y in seen}
    return found


def dag(seed, n, m):
    r = random.Random(seed)
    name = r.sample(range(1000), n)  # names say nothing about the order
    return sorted({(name[a], name[b]) for a, b in (sorted((r.randrange(n), r.randrange(n))) for _ in range(m)) if a != b})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_of_one_successor(spark, seed):
    r = random.Random(seed)
    nxt = {i: r.randrange(90) for i in range(60)}  # from 60 on there is no successor
    nxt |= {100: 101, 101: 100, 102: 102, 103: 100} if seed == 2 else {}
    got = chains.follow(spark.createDataFrame(list(nxt.items()), "id long, to long"))
    ended, circles, endless = {}, {}, set()
    for x in nxt:
        y, steps = x, 0
        while y in nxt and steps <= len(nxt):
            y, steps = nxt[y], steps + 1
        if y not in nxt:
            ended[x] = (y, steps)
            continue
        endless.add(x)
        around = {y}
        while (y := nxt[y]) not in around:
            around.add(y)
        if x in around:
            circles[x] = min(around)
    assert {q["id"]: (q["root"], q["dist"]) for q in got.ended.collect()} == ended
    assert {q["id"]: q["comp"] for q in got.circles.collect()} == circles
    assert {q["id"] for q in got.endless.collect()} == endless


@pytest.mark.parametrize("n, m", [(60, 60), (60, 80), (40, 160)])
def test_components_of_sparse_graphs_and_their_order(spark, n, m):
    r = random.Random(n + m)
    pairs = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)} | {(200 + i, 201 + i) for i in range(30)} | {(225, 210), (3, 200)})
    nodes, reach = {x for p in pairs for x in p}, reach_of(pairs)
    want = {x: min([x, *(y for y in nodes if (x, y) in reach and (y, x) in reach)]) for x in nodes}
    e = edges_of(spark, pairs)
    got = tables.materialize(paths.strong_components(e, e.select(F.col("src").alias("id"))))
    assert {q["node"]: (q["comp"], q["cyclic"]) for q in got.collect()} == {x: (c, (x, x) in reach) for x, c in want.items()}
    order = {q["comp"]: (q["level"], q["place"]) for q in paths.component_order(e, got).collect()}
    assert sorted(p for _, p in order.values()) == list(range(len(set(want.values()))))
    assert all(order[want[b]] < order[want[a]] and order[want[b]][0] < order[want[a]][0] for a, b in pairs if want[a] != want[b])


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_and_reduction(spark, seed):
    pairs = dag(seed, 40, 110)
    high = {}
    for _ in pairs:
        for a, b in pairs:
            high[a], high[b] = max(high.get(a, 0), high.get(b, 0) + 1), high.get(b, 0)
    e = edges_of(spark, pairs)
    assert {q["id"]: q["level"] for q in paths.levels(e).collect()} == high
    assert {q["id"]: q["level"] for q in paths.levels(edges_of(spark, pairs + [(2000, 2001), (2001, 2000), (2002, 2000), (2003, 2002), (2003, pairs[0][0])])).collect()} == high
    out = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    reach = reach_of(pairs)
    want = {(a, b) for a, b in pairs if not any((w, b) in reach for w in out[a])}
    plan = paths.transitive_reduction(e)
    assert {(q["src"], q["dst"]) for q in plan.collect()} == want and plan.columns == ["src", "dst", "label"]
    index = {q["id"]: q for q in paths.reach_index(e).collect()}
    inside = lambda x, y: index[x]["level"] > index[y]["level"] and all(index[x][f"lo{i}"] <= index[y][f"lo{i}"] and index[x][f"hi{i}"] >= index[y][f"hi{i}"] for i in range(paths.LABELS))
    maybe = {(x, y) for x in index for y in index if inside(x, y)}
    assert reach <= maybe and len(maybe) < 1.5 * len(reach)  # the labels decide most pairs


def test_a_long_chain_takes_few_rounds(spark):
    before = len(tables._written)
    chain = [(i, i + 1) for i in range(1000)]
    assert {q["id"]: q["level"] for q in paths.levels(edges_of(spark, chain)).collect()} == {i: 1000 - i for i in range(1001)}
    assert len(tables._written) - before < 25


def test_rounds_write_what_they_touch(spark, monkeypatch):
    """A broad chain, which can't be contracted: rows written are linear in the edges."""
    pairs = [(2 * i + a, 2 * i + 2 + b) for i in range(40) for a in (0, 1) for b in (0, 1)]
    rows, write = [], paths.materialize_counting
    monkeypatch.setattr(paths, "materialize_counting", lambda *a: rows.append((out := write(*a))[0].count()) or out)
    assert len(paths.levels(edges_of(spark, pairs)).collect()) == 82
    assert sum(rows) <= len(pairs)


def test_closure_leaves_known_pairs_where_they_are(spark):
    """A round's plan has no shuffle over the parts of what is known, or over the edges."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = edges_of(spark, dag(5, 30, 60))
        known = tables.bucketed(e.select("src", "dst", "label", F.lit(0).alias("round")), "src", "dst")
        found = paths._Known(known, "src", "dst")
        found.add(tables.bucketed(e.where("src > 500").select("src", "dst", "label", F.lit(1).alias("round")), "src", "dst"))
        by_src = tables.bucketed(e.select(F.col("src").alias("_m"), "dst", F.col("label").alias("_b")), "_m")
        step = paths._extended(known.where("src < 10"), by_src, MIN_PLUS)
        plan = found.labels_of(step)
        text = plan._jdf.queryExecution().executedPlan().toString()
        lines = text[text.index("Initial Plan") if "Initial Plan" in text else 0 :].splitlines()
        assert sum("FileScan" in x for x in lines) == 4
        assert sum("Exchange" in x for x in lines) == 2  # the delta by its end, and what it leads to by pair
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("seed", range(4))
def test_offsets_or_the_loop_that_forbids_them(spark, seed):
    r = random.Random(seed)
    n = 14
    cost = {(a, b): r.randrange(-3 if seed % 2 else 0, 9) for a, b in [(r.randrange(n), r.randrange(n)) for _ in range(30)]}
    if not seed % 2:  # shifted by potentials: consistent, with negative labels
        cost = {(a, b): c + (a * 7) % 10 - (b * 7) % 10 for (a, b), c in cost.items()}
    value, falls = {x: 0 for e in cost for x in e}, True
    for _ in value:
        falls = [value.__setitem__(b, value[a] + c) for (a, b), c in cost.items() if value[a] + c < value[b]]
    values, loops = paths.consistent_offsets(spark.createDataFrame([(a, b, c) for (a, b), c in cost.items()], "src long, dst long, label long"))
    assert {q["id"]: q["value"] for q in values.collect()} == ({} if falls else value)
    of = {}
    for q in sorted(loops.collect(), key=lambda q: q["place"]):
        of.setdefault(q["loop"], []).append(q["id"])
    assert bool(of) == bool(falls)
    for name, loop in of.items():
        assert loop[0] == name == min(loop) and sum(cost[a, b] for a, b in zip(loop, loop[1:] + loop[:1])) < 0


def test_sweeps_of_a_large_group_are_linear(spark):
    n = 400_000
    rows = spark.range(n).select(F.lit(1).alias("grp"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + F.when(F.col("id") % 1000 == 0, 5).otherwise(2)).alias("end"))
    start = time.perf_counter()
    assert intervals.violations(rows).groupBy("problem").count().collect()[0]["count"] == n // 1000
    assert intervals.subtract(rows, rows.where("start % 2 = 0")).count() > 0
    got = grouping.prefix_and_suffix_runs(rows, "grp", "start", F.col("start") > 30).agg(F.count_if("in_suffix"), F.count_if("in_prefix"), F.max("from_end")).first()
    assert tuple(got) == (n - 11, 0, n)
    assert time.perf_counter() - start < 60  # a frame to the group's end would take an hour
