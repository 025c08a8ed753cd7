"""Laws on random small inputs against plain Python, worked examples, and empty and skewed inputs."""

from __future__ import annotations

import random
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.functions.semiring import BOOLEAN, COUNTING, MIN_PLUS, POLARITIES, POLARITY, polarity_plus, polarity_times
from tessera.operators import components, graph, grouping, hierarchy, intervals, matrix, paths, repo, sweeps, text
from tessera.plans import views
from tessera.plans.registry import QUERIES
from tessera.sources import files
from tessera.streaming import jobs

E = "src long, dst long, label long"


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], E)


def random_graph(seed, n=9, m=14, acyclic=False):
    r = random.Random(seed)
    out = {}
    for _ in range(m):
        a, b = r.randrange(n), r.randrange(n)
        if not acyclic or a > b:
            out[a, b] = r.randrange(1, 9)
    return out


def closure_of(pairs):
    reach = set(pairs)
    while True:
        more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
        if not more:
            return reach
        reach |= more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_slow_closure_is_fast_closure_and_components_agree(spark, seed):
    g = random_graph(seed)
    reach = closure_of(g)
    got = paths.closure(edges_of(spark, g).withColumn("label", F.lit(True)), BOOLEAN)
    assert {(r["src"], r["dst"]) for r in got.collect()} == reach
    dist = {}
    for (a, b), w in g.items():
        dist[a, b] = w
    for k in range(9):
        for i in range(9):
            for j in range(9):
                if (i, k) in dist and (k, j) in dist:
                    dist[i, j] = min(dist.get((i, j), 10**9), dist[i, k] + dist[k, j])
    assert {(r["src"], r["dst"]): r["label"] for r in paths.closure(edges_of(spark, g), MIN_PLUS).collect()} == dist
    nodes = {x for e in g for x in e}
    want = {x: min([x, *(y for y in nodes if (x, y) in reach and (y, x) in reach)]) for x in nodes}
    scc = paths.strong_components(edges_of(spark, g), spark.createDataFrame([(x,) for x in nodes], "id long")).collect()
    assert {r["node"]: r["comp"] for r in scc} == want
    assert {r["node"] for r in scc if r["cyclic"]} == {x for x in nodes if (x, x) in reach}
    assert paths.is_acyclic(edges_of(spark, g)) == (not any((x, x) in reach for x in nodes))


@pytest.mark.parametrize("seed", [4, 5])
def test_reduction_keeps_reachability_and_contraction_keeps_paths(spark, seed):
    g = random_graph(seed, 9, 22, acyclic=True)
    e = edges_of(spark, g)
    small = {(r["src"], r["dst"]) for r in paths.transitive_reduction(e).collect()}
    assert closure_of(small) == closure_of(g)
    assert all(closure_of(small - {x}) != closure_of(g) for x in small)
    keep = {x for x in range(9) if x % 2}
    got = paths.drop_nodes_keep_paths(e, spark.createDataFrame([(x,) for x in keep], "id long"), MIN_PLUS).collect()
    assert closure_of({(r["src"], r["dst"]) for r in got}) == {(a, b) for a, b in closure_of(g) if a in keep and b in keep}
    counts = {(r["src"], r["dst"]): (r["length"], r["paths"]) for r in paths.longest_paths(e).collect()}
    for (a, b), (n, k) in counts.items():
        walks = defaultdict(int)

        def go(x, d):
            if x == b:
                walks[d] += 1
            for (s, t) in g:
                if s == x:
                    go(t, d + 1)

        go(a, 0)
        assert (n, k) == (max(walks), walks[max(walks)])


def test_cycles_are_refused(spark):
    loop = edges_of(spark, {(1, 2): 1, (2, 1): 1})
    for f in (paths.topological_order, paths.longest_paths, paths.transitive_reduction):
        with pytest.raises(ValueError):
            f(loop)
    bad = paths.difference_constraints(edges_of(spark, {(1, 2): 3, (2, 1): -5}))[1]
    assert {r["id"] for r in bad.collect()} == {1, 2}


def test_connected_components_hub_and_chain(spark):
    rows = [(0, i, 1) for i in range(1, 400)] + [(1000 + i, 1001 + i, 1) for i in range(60)] + [(7, 7, 1), (None, 3, 1)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(rows, E)).collect()}
    assert got == {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(61)}
    assert components.connected_components(spark.createDataFrame([], E)).collect() == []


def test_clusters_of_the_worked_example(spark):
    words = "anabel bond babel hurz furz kurz".split()
    two = spark.createDataFrame([(w, [w[0], w[1]]) for w in words], "item string, keys array<string>")
    got = defaultdict(set)
    for r in paths.cluster(two, "item", "keys").collect():
        got[r["cluster"]].add(r["item"])
    assert sorted(map(sorted, got.values())) == [["anabel", "babel", "bond"], ["furz", "hurz", "kurz"]]
    one = two.withColumn("keys", F.slice("keys", 1, 1))
    assert len({r["cluster"] for r in paths.cluster(one, "item", "keys").collect()}) == 5


def test_versions_of_the_worked_example(spark):
    def best(wanted, libs):
        w = spark.createDataFrame([(wanted,)], "wanted string")
        return {r["name"] for r in repo.best_matches(w, spark.createDataFrame([(x,) for x in libs], "name string")).collect()}

    assert best("a", ["a-1", "a-02", "a-2", "b"]) == {"a-02", "a-2"}
    assert best("a", ["a", "a-1", "a-01", "a-2", "b"]) == {"a"}
    assert best("a-1", ["a", "a-1", "a-01", "a-2", "b"]) == {"a-1", "a-01"}
    assert best("a-2", ["a", "a-1", "a-01", "a-2", "b"]) == {"a-2"} and best("c", ["a", "b"]) == set()
    assert best("z", ["z-2", "z-2.0.1", "z-10"]) == {"z-10"} and best("z", ["z-2", "z-2.0.1"]) == {"z-2.0.1"}
    long = "9" * 62
    base, v = repo.parse_version_name(F.col("n"))
    rows = spark.createDataFrame([("foo-1.2.3",), ("foo-001.02.3",), ("bar",), (f"x-{long}",)], "n string").select(base.alias("b"), v.alias("v")).collect()
    assert [(r["b"], r["v"]) for r in rows] == [("foo", ["1", "2", "3"]), ("foo", ["1", "2", "3"]), ("bar", []), ("x", [long])]


def random_ranges(seed, groups=3, n=8):
    r = random.Random(seed)
    return [(g, a, a + r.randrange(0, 9), s, f"v{s}") for g in range(groups) for s in range(n) for a in [r.randrange(0, 40)]]


def positions(rows):
    out = defaultdict(set)
    for g, a, b, *_ in rows:
        out[g] |= set(range(a, b))
    return {g: p for g, p in out.items() if p}


@pytest.mark.parametrize("most, struct", [(10**6, False), (3, False), (3, True)])
def test_order_based_laws(spark, monkeypatch, most, struct):
    monkeypatch.setattr(sweeps, "SPLIT", most)  # 3: every group is worked in pieces
    r = random.Random(5)
    rows = [(g, s, r.choice([None, 1, 2, 3]), r.choice("ab")) for g in (1, 2, 3, None) for s in r.sample(range(500), 90 if g == 2 else 30)]
    df = spark.createDataFrame([(g, (s, "x") if struct else s, v, t, s) for g, s, v, t in rows], f"g long, seq {'struct<n: long, t: string>' if struct else 'long'}, v long, t string, s long")
    of = defaultdict(list)
    for g, s, v, t in sorted(rows, key=lambda x: x[1]):
        of[g].append((s, v, t))
    by = lambda d, *c: {(q["g"], q["s"]): tuple(q[x] for x in c) for q in d.collect()}
    want, holds = {}, {}
    for g, all_rows in of.items():
        run = segment = 0
        holds[g] = all(a[2] <= b[2] for a, b in zip(all_rows, all_rows[1:]))
        for i, (s, v, t) in enumerate(all_rows):
            run += not (i and v is not None and all_rows[i - 1][1] == v)
            known = [x for x in (q[1] for q in all_rows[: i + 1]) if x is not None], [x for x in (q[1] for q in all_rows[i:]) if x is not None]
            prefix, suffix = (all(x > 1 for x in k) if k else None for k in known)
            want[g, s] = (run, i // 4, segment, t == "a", prefix, suffix, len(all_rows) - i)
            segment += t == "a"
    d = grouping.runs(df, "g", "seq", lambda before: before["v"] == F.col("v"))
    d = grouping.split_when(grouping.chunks(d, "g", "seq", 4), "g", "seq", F.col("t") == "a")
    d = grouping.prefix_and_suffix_runs(d, "g", "seq", F.col("v") > 1)
    assert by(d, "run", "chunk", "segment", "is_separator", "in_prefix", "in_suffix", "from_end") == want
    assert {q["g"]: q["holds"] for q in grouping.consecutive_check(df, "g", "seq", lambda before: before["t"] <= F.col("t")).collect()} == holds
    stamps = df.select("g", F.timestamp_millis("s").alias("ts"), F.when(F.col("v").isNotNull(), F.col("t")).alias("account"))
    bills = defaultdict(int)
    for g, all_rows in of.items():
        for (s, v, t), after in zip(all_rows, all_rows[1:]):
            if v is not None:
                bills[g, t] += after[0] - s
    assert {(q["g"], q["account"]): q["ms"] for q in grouping.bill_switches(stamps, "g", "ts", "account").collect()} == bills
    left, right = df.where("g is not null").select("g", "seq", F.col("s").alias("value")), df.where("g is not null and s % 2 = 0").select("g", "seq", F.col("s").alias("value"))
    pairs = {(q["g"], q["pos"]): (q["left"], q["right"]) for q in grouping.align_groups(left, right, "g", "seq").collect()}
    for g in (1, 2, 3):
        a, b = [s for s, *_ in of[g]], [s for s, *_ in of[g] if s % 2 == 0]
        assert [pairs[g, i + 1] for i in range(len(a))] == [(x, b[i] if i < len(b) else None) for i, x in enumerate(a)]


def test_locate_cuts_paths_at_every_slash(spark):
    files = ["a/b/m.src", "a/b/m.lit", "a/b/m.src.lit", "a/n.src", "b/n.src", "c/q.src", "a/b.c", "/r.src", "", "plain", "a/.src"]
    names, dirs, ends = ["b/m", "m", "m.src", "n", "q", "r", "", "b", "none", None], ["a", "a/b", "b", ""], [".src", ".lit", ".src.lit", ""]
    as_frame = lambda values, c: spark.createDataFrame([(x,) for x in values], f"{c} string")
    got = {q["name"]: (q["status"], q["path"]) for q in repo.locate(as_frame(names, "name"), as_frame(dirs, "dir"), as_frame(ends, "ext"), as_frame(files + files, "path")).collect()}
    for name in names:
        hits = {f for f in files for d in dirs for e in ends if name is not None and f"{d}/{name}{e}" == f}
        assert got[name] == (("Found", *hits) if len(hits) == 1 else ("Ambiguous" if hits else "NotFound", None))


def test_views_of_one_thread_are_its_own():
    with views.whole("main_next"):
        with ThreadPoolExecutor(1) as other:
            assert not other.submit(views._WHOLE.get).result() and views._WHOLE.get() == {"main_next"}
    assert not views._WHOLE.get()


def test_classes_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "id long, c string")
    whole = {(q["id"], q["class"]) for q in grouping.classed(df, F.col("c"), ["a", "b"]).collect()}
    assert whole == {(1, "a"), (2, "b"), (3, ""), (4, "")} == {(q["id"], n) for n, d in grouping.partition_by_class(df, F.col("c"), ["a", "b"]).items() for q in d.collect()}


R = "grp long, start long, end long, seq long, value string"


@pytest.mark.parametrize("seed, most", [(1, 10**6), (2, 3)])
def test_interval_laws(spark, monkeypatch, seed, most):
    monkeypatch.setattr(sweeps, "SPLIT", most)  # 3: every group is worked in pieces
    a, b = random_ranges(seed), random_ranges(seed + 50)
    da, db = spark.createDataFrame(a, R), spark.createDataFrame(b, R)
    as_rows = lambda df: [(r["grp"], r["start"], r["end"]) for r in df.collect()]
    pa, pb = positions(a), positions(b)
    assert positions(as_rows(intervals.fuse(da))) == pa
    assert intervals.violations(intervals.fuse(da)).collect() == []
    assert positions(as_rows(intervals.subtract(da, db))) == {g: x for g in pa if (x := pa[g] - pb.get(g, set()))}
    want = {(x[0], x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]}
    for width in (1, 3, 100):
        got = [(r["grp"], r["seq"], r["b_seq"]) for r in intervals.overlap_join(da, db, width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {r["grp"] for r in intervals.overlap_exists(da, db).collect()} == {g for g, _, _ in want}
    merged = [(g, s, t, e, q) for t, rows in ((0, a), (1, b)) for g, s, e, q, _ in rows]
    clash = set()
    for g, s, t, e, _ in merged:
        rest = [(y[3], y[1]) for y in sorted(merged, key=lambda y: (y[1], y[3], y[2])) if y[0] == g and y[2] != t and (y[1], y[3], y[2]) > (s, e, t)]
        if rest and rest[0][1] < e and s < rest[0][0]:
            clash.add((g, t, s, e, rest[0][1], rest[0][0]))
    assert {tuple(r) for r in intervals.ordered_conflicts(da, db).collect()} == clash
    points = spark.createDataFrame([(g, p, f"{g}/{p}") for g in range(4) for p in range(50)], "grp long, pos long, note string")
    assert {(r["grp"], r["pos"]) for r in intervals.unbounded_member(points, da.select("grp", "start", "end")).collect()} == {(g, p) for g, x in pa.items() for p in x}
    ordered = {g: sorted(x[1:3] for x in a if x[0] == g) for g in range(3)}
    bad = sorted((g, s, e) for g, x in ordered.items() for (s, e), n in zip(x, [*x[1:], (10**9, 0)]) if s >= e or n[0] <= e)
    assert sorted(tuple(r)[:3] for r in intervals.violations(da).collect()) == bad
    lined = da.where("start < end").select("grp", "start", "end", F.expr("start div 10").alias("line_start"), F.expr("`end` div 10").alias("line_end"))
    fused = defaultdict(list)
    for g, s, e in sorted((g, s, e) for g, s, e, *_ in a if s < e):
        if fused[g] and fused[g][-1][2] == s // 10:
            fused[g][-1] = [fused[g][-1][0], max(e, fused[g][-1][1]), e // 10]
        else:
            fused[g].append([s, e, e // 10])
    assert {(r["grp"], r["start"], r["end"]) for r in intervals.fuse_per_line(lined).collect()} == {(g, s, e) for g, x in fused.items() for s, e, _ in x}
    # an overlay holds at every position the values that cover it, newest first
    cover = defaultdict(list)
    for g, s, e, q, v in a:
        for p in range(s, e):
            cover[g, p].append((q, v))
    seen = {}
    for r in intervals.overlay(da).collect():
        for p in range(r["start"], r["end"]):
            seen[r["grp"], p] = r["labels"]
    assert seen == {k: [v for _, v in sorted(x, reverse=True)] for k, x in cover.items()}
    flat = intervals.expand(da).groupBy("grp", "pos").agg(F.max("value").alias("value"))
    back = intervals.expand(intervals.coalesce_positions(flat)).select("grp", "pos", "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))


def test_runs_go_on_over_the_borders_of_stretches(spark, monkeypatch):
    monkeypatch.setattr(intervals, "STRETCH", 4)
    r = random.Random(3)
    at = {(g, v, p) for g in (1, None) for v in ("a", None) for p in range(-20, 40) if r.random() < 0.8} | {(2, "b", p) for p in range(-9, 30)}
    rows = sorted(at, key=repr)
    got = intervals.coalesce_positions(spark.createDataFrame([*rows, *rows[:9]], "grp int, value string, pos long"))
    want = {(g, v, p, next(e for e in range(p, 99) if (g, v, e) not in at)) for g, v, p in at if (g, v, p - 1) not in at}
    assert sorted((tuple(q) for q in got.select("grp", "value", "start", "end").collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("most", [3, 1_000_000])
def test_ranges_coalesce_as_their_positions_do(spark, monkeypatch, most):
    """Also ranges of more positions than could be told."""
    monkeypatch.setattr(sweeps, "SPLIT", most)
    r = random.Random(8)
    rows = [(g, s, s + r.randrange(-2, 5), v) for g in (1, 2, None) for v in ("a", "b", None) for s in r.sample(range(-30, 60), 12)]
    d = spark.createDataFrame([*rows, *rows[:9], (1, None, 5, "a"), (1, 5, None, "a")], "grp int, start long, end long, value string")
    want = intervals.coalesce_positions(intervals.expand(d).select("grp", "pos", "value"))
    got = intervals.coalesce_ranges(d)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    long = spark.createDataFrame([(1, 0, 1 << 40, "a"), (1, 1 << 40, 1 << 41, "a"), (1, 1 << 42, 1 << 43, "a"), (1, 5, 1 << 41, "b")], "grp int, start long, end long, value string")
    assert sorted(map(tuple, intervals.coalesce_ranges(long).collect())) == [(1, 0, 1 << 41, "a"), (1, 5, 1 << 41, "b"), (1, 1 << 42, 1 << 43, "a")]


def test_the_day_query_makes_no_row_for_a_day(spark, monkeypatch):
    monkeypatch.setattr(intervals, "expand", None)
    assert QUERIES["r3_coalesce_days"](spark, "/root/testdata/sf0.001").count() > 0


def test_unbounded_sets(spark):
    ray = lambda *rows: spark.createDataFrame(list(rows), "grp long, start long, end long")
    got = intervals.unbounded_union(ray((1, None, 3)), ray((1, 3, None)))
    assert [tuple(r) for r in got.collect()] == [(1, None, None)]
    got = intervals.unbounded_difference(ray((1, None, None)), ray((1, 2, 5)))
    assert sorted((r["start"] is not None, r["start"], r["end"]) for r in got.collect()) == [(False, None, 2), (True, 5, None)]


def test_windows_and_lists(spark):
    rows = [(1, 0, "A"), (1, 1, "b"), (1, 2, "C"), (1, 3, "d"), (1, 4, "e")]
    df = spark.createDataFrame(rows, "g long, seq long, c string")
    low = F.col("c") == F.lower("c")
    assert [r["in_suffix"] for r in grouping.prefix_and_suffix_runs(df, "g", "seq", low).orderBy("seq").collect()] == [False, False, False, True, True]
    sep = grouping.split_when(df, "g", "seq", F.col("c").isin("A", "b")).orderBy("seq").collect()
    assert [(r["segment"], r["is_separator"]) for r in sep] == [(0, True), (1, True), (2, False), (2, False), (2, False)]
    r = random.Random(3)
    rows = [(i, r.randrange(5), r.randrange(9)) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, key long, fav long")
    want = {k: min((f, s) for s, q, f in rows if q == k) for k in {q for _, q, _ in rows}}
    assert {x["key"]: (x["fav"], x["seq"]) for x in grouping.favourite_per_key(df, "key", "fav", "seq").collect()} == want
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "seq long, value string"), spark.createDataFrame([(5, "z")], "seq long, value string")
    assert [tuple(x) for x in grouping.align(a, b, "seq").orderBy("pos").collect()] == [(1, "x", "z"), (2, "y", None)]


def test_skyline_is_the_antichain(spark):
    r = random.Random(8)
    rows = [(i, r.randrange(9), r.randrange(9)) for i in range(80)]
    got = {x["id"] for x in grouping.skyline(spark.createDataFrame(rows, "id long, a long, b long").repartition(3), ["a", "b"], "id").collect()}
    beaten = lambda x: any(y[1] <= x[1] and y[2] <= x[2] and (y[1:] != x[1:] or y[0] < x[0]) for y in rows if y != x)
    assert got == {x[0] for x in rows if not beaten(x)}


def test_matrix_laws(spark):
    r = random.Random(2)
    a = {(r.randrange(1, 5), r.randrange(1, 5)): r.randrange(-3, 4) or 1 for _ in range(9)}
    b = {(r.randrange(1, 5), r.randrange(1, 5)): r.randrange(-3, 4) or 1 for _ in range(9)}
    m = lambda x: spark.createDataFrame([(i, j, v) for (i, j), v in x.items()], "i long, j long, v long")
    cells = lambda d: {(x["i"], x["j"]): x["v"] for x in d.collect()}
    add = {k: s for k in a.keys() | b.keys() if (s := a.get(k, 0) + b.get(k, 0))}
    mul = {(i, j): s for i in range(1, 5) for j in range(1, 5) if (s := sum(a.get((i, k), 0) * b.get((k, j), 0) for k in range(1, 5)))}
    assert cells(matrix.add(m(a), m(b))) == add and cells(matrix.multiply(m(a), m(b), COUNTING, F.lit(0))) == mul
    assert matrix.compare(m(a), m(a), (4, 4), (4, 4)).first()[0] == "EQ" and matrix.compare(m(a), m({}), (4, 4), (4, 4)).first()[0] == "GT"


def test_blocked_product_is_the_sparse_one(spark, monkeypatch):
    monkeypatch.setattr(matrix, "BLOCK", 8)
    r = random.Random(2)
    cells = lambda n, k, most: spark.createDataFrame([(i, j, r.randrange(-most, most)) for i in range(1, n + 1) for j in range(1, k + 1) if r.random() < 0.3 or j == 3], "i long, j long, v long").where("v <> 0")
    for most in (5, 1 << 29):
        a, b = cells(21, 30, most), cells(26, 17, most)
        rows = lambda d: sorted(map(tuple, d.select("i", "j", "v").collect()))
        assert rows(matrix.multiply_blocked(a, b)) == rows(matrix.multiply(a, b, COUNTING, F.lit(0)))
    assert matrix.multiply_blocked(a.limit(0), b).collect() == []


def test_occurrence_semiring_laws(spark):
    one = spark.createDataFrame([(a, b, c) for a in POLARITIES for b in POLARITIES for c in POLARITIES], "a string, b string, c string")
    t = polarity_times
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    assert one.where((t(t(a, b), c) != t(a, t(b, c))) | (t(a, b) != t(b, a)) | (t(a, F.lit("++")) != a) | (t(a, F.lit("_")) != "_")).isEmpty()
    plus = lambda *x: one.select("a", "b", "c", F.explode(F.array(*x)).alias("x")).groupBy("a", "b", "c").agg(polarity_plus(F.col("x")).alias("s"))
    left = plus(b, c).withColumn("l", t(F.col("a"), F.col("s"))).drop("s")
    right = plus(t(a, b), t(a, c)).withColumnRenamed("s", "r")
    assert left.join(right, ["a", "b", "c"]).where("l <> r").isEmpty()


def test_compressed_paths_expand_again(spark):
    rows = [(["a", "b", "c"], 1), (["a", "b", "c", "d", "e"], 2), (["x", "y"], 3), (["a", "b"], 4)]
    p = spark.createDataFrame(rows, "path array<string>, value long")
    c = hierarchy.uncompress(hierarchy.compress(p))
    assert {tuple(r["path"]) for r in c.where("valued").collect()} == {tuple(x) for x, _ in rows}
    segs = {tuple(r["path"]): [list(s) for s in r["segments"]] for r in c.collect()}
    assert segs[("a", "b", "c", "d", "e")] == [["a", "b"], ["c"], ["d", "e"]] and segs[("x", "y")] == [["x", "y"]] and segs[()] == []
    order = [tuple(r["path"]) for r in hierarchy.preorder(p).orderBy("position").collect()]
    assert order == [("x", "y"), ("a", "b"), ("a", "b", "c"), ("a", "b", "c", "d", "e")] or order.index(("a", "b")) < order.index(("a", "b", "c"))


LITERATE = [
    ("md", False, "a\n```code\ncode\n```\nb\n```\nmore\n```", "code\nmore\n", "```code\n```\n```\n```"),
    ("md", True, "```code\ncode\n```\n```\nmore\n```\nend", "code\n", "```code\n```\n"),
    ("md", False, "```haskell\nx\n```\nprose\n```\ncode\n ```\n", "code\n", "```\n ```\n"),
    ("md", False, "- item ```code\ncode\n```\n", "code\n", "```code\n```\n"),
    ("md", False, "```\nopen to\x0cthe\u2028end", "open to\x0cthe\u2028end", "```\n"),
    ("tex", False, "text \\begin{code}[hide]\nx = 1\n  \\end{code} post\nend", "\nx = 1\n  ", "\\begin{code}[hide]\\end{code}"),
    ("tex", False, "% \\begin{code}\n\\% \\begin{code}\ny\n\\end{code}\n", "\ny\n", "\\begin{code}\\end{code}"),
    ("rst", False, "Title\n\nhere::\n\n  code\n\n  more\n\nback\n.. note::\n  no", "  code\n\n  more\n\n", ":\n\n"),
    ("rst", False, "::\n\n    a\n  b ::\n   c\n", "    a\n   c\n", "::\n\n  b ::\n"),
    ("org", False, "x\n#+begin_src code\ny\n#+end_src\n#+begin_src haskell\nz\n#+BEGIN_SRC code :tangle no\nw", "y\nw", "#+begin_src code\n#+end_src\n#+BEGIN_SRC code :tangle no\n"),
    ("tree", False, "t \\code{\nc\n}\nd } e\n", "\nc\n", "\\code{}"),
]


@pytest.mark.parametrize("format, tagged, source, code, markup", LITERATE)
def test_literate_layers(format, tagged, source, code, markup):
    got = text.literate_layers(source, format, tagged)
    assert "".join(source[a:b] for _, a, b in got) == source
    assert "".join(source[a:b] for r, a, b in got if r == "Code") == code
    assert "".join(source[a:b] for r, a, b in got if r == "Markup") == markup


def test_layers_of_odd_formats(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "html", "x"), (3, "md", None), (4, "md", ""), (5, "md", "x")], "doc_id long, format string, text string")
    assert [(r["doc_id"], r["role"]) for r in text.layers(d).collect()] == [(5, "Comment")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_nested_cycles(spark, seed):
    r = random.Random(seed)
    g = {(r.randrange(40), r.randrange(40)): 1 for _ in range(55)}
    g |= {(i, i + 1): 1 for i in range(100, 130)} | {(115, 103): 1, (110, 107): 1, (129, 118): 1}
    reach = closure_of(g)
    nodes = {x for e in g for x in e}
    want = {x: min([x, *(y for y in nodes if (x, y) in reach and (y, x) in reach)]) for x in nodes}
    scc = paths.strong_components(edges_of(spark, g), spark.createDataFrame([(999,)], "id long")).collect()
    assert {r["node"]: r["comp"] for r in scc} == want | {999: 999}


def test_bounded_walks_multiply_along_a_shortest_walk(spark):
    e = spark.createDataFrame([(1, 2, "+"), (2, 4, "-"), (1, 3, "g+"), (3, 4, "-"), (4, 5, "-"), (1, 5, "_")], "src long, dst long, label string")
    cases = [(F.col("label") == "*", F.lit(True)), (F.col("label") != "_", F.col("label") == "g+")]
    got = paths.bounded_walks(e, F.lit(1), F.lit(5), cases, POLARITY).collect()
    times = spark.range(1).select(polarity_times(polarity_times(F.lit("g+"), F.lit("-")), F.lit("-")).alias("x")).first()["x"]
    assert [(r["walk"], r["product"]) for r in got] == [([1, 3, 4, 5], times)]
    assert paths.bounded_walks(e, F.lit(5), F.lit(1), cases, POLARITY).collect() == []


def test_all_longest_paths(spark):
    g = random_graph(11, 9, 24, acyclic=True)
    e = edges_of(spark, g)
    want = defaultdict(set)

    def go(path):
        want[path[0], path[-1]].add(path)
        for s, t in g:
            if s == path[-1]:
                go((*path, t))

    for x in {x for k in g for x in k}:
        go((x,))
    want = {k: {p for p in v if len(p) == max(map(len, v))} for k, v in want.items()}
    pairs = spark.createDataFrame([*want, (0, 77)], "src long, dst long")
    got = defaultdict(set)
    for r in paths.longest_path_lists(e, pairs).collect():
        got[r["src"], r["dst"]].add(tuple(r["path"]))
    assert got == want


def test_path_lists_look_for_the_asked_ends_only(spark, monkeypatch):
    """No row for each pair of nodes, and no path that is no part of an asked one."""
    made = []

    def counted(*args):
        made.append(longest_paths(*args))
        return made[-1]

    longest_paths = paths.longest_paths
    monkeypatch.setattr(paths, "longest_paths", counted)
    lists = lambda e, *pairs: sorted((r["src"], r["dst"], r["path"]) for r in paths.longest_path_lists(e, spark.createDataFrame(list(pairs), "src long, dst long")).collect())
    halves = edges_of(spark, {(n, d): 1 for n in range(2, 14) for d in (n // 2, n // 3) if d})
    assert [x[2] for x in lists(halves, (12, 1), (7, 1))] == [[7, 2, 1], [7, 3, 1], [12, 4, 2, 1], [12, 6, 2, 1], [12, 6, 3, 1]]
    assert made[0].count() == 13
    layers = edges_of(spark, {(60 * k + i, 60 * (k - 1) + j): 1 for k in range(1, 6) for i in range(60) for j in range(60)})  # 60^4 paths from each node on top to each below
    assert lists(layers, (125, 3), (65, 3), (3, 3), (3, 65)) == [(3, 3, [3]), (65, 3, [65, 3]), *((125, 3, [125, j, 3]) for j in range(60, 120))]
    assert lists(edges_of(spark, {(2, 1): 1}), (1, 2), (9, 1)) == []
    with pytest.raises(ValueError):
        lists(edges_of(spark, {(5, 6): 1, (6, 5): 1, (2, 1): 1}), (2, 1))


def test_negative_loops_force_nodes_to_infinity(spark):
    g = {(1, 2): 3, (2, 3): -4, (3, 1): 0, (3, 4): 1, (5, 1): 2}
    assert {r["id"] for r in paths.forced_to_infinity(edges_of(spark, g)).collect()} == {1, 2, 3}
    assert paths.forced_to_infinity(edges_of(spark, {(1, 2): 3, (2, 1): -3})).collect() == []


def test_hashes_combine_in_order(spark):
    rows = [(f"s{i % 2}", i * 3, i * 7919) for i in range(200)]
    d = spark.createDataFrame(rows, "source string, doc_id long, hash long")
    one = lambda values: text.combine_hashes(F.array(*[F.lit(v).cast("long") for v in values]))

    def combined(values, fan):  # (seq, hash) pairs
        groups = defaultdict(list)
        for s, h in sorted(values):
            groups[s // fan].append(h)
        keys = sorted(groups)
        got = spark.range(1).select(*[one(groups[k]).alias(f"c{k}") for k in keys]).first()
        return list(zip(keys, got))

    for fan in (1000, 20):
        want = {}
        for source in ("s0", "s1"):
            level, top = combined([(s, h) for x, s, h in rows if x == source], fan), 597 // fan
            while top:
                level, top = combined(level, fan), top // fan
            want[source] = level[0][1]
        assert {r["source"]: r["combined"] for r in text.combined_hashes(d.repartition(5), "source", "doc_id", fan).collect()} == want
    swapped = d.withColumn("doc_id", F.when(F.col("doc_id") == 0, 6).when(F.col("doc_id") == 6, 0).otherwise(F.col("doc_id")))
    assert text.combined_hashes(swapped, "source", "doc_id").where("source = 's0'").first()["combined"] != text.combined_hashes(d, "source", "doc_id").where("source = 's0'").first()["combined"]


def test_float_parts_give_back_the_float(spark):
    from fractions import Fraction

    from tessera.plans.registry import QUERIES

    for r in QUERIES["t15_float_parts"](spark, "/root/testdata/sf0.001").collect():
        a = r["a"]
        if a != a or a in (float("inf"), float("-inf")):
            assert (r["numerator"], r["denominator"]) == ("0" if a != a else "1" if a > 0 else "-1", "0") and r["mantissa"] is None and r["encoded"] is None
        else:
            assert Fraction(int(r["numerator"]), int(r["denominator"])) == Fraction(a) and r["encoded"] == a and (r["mantissa"] % 2 or a == 0)


def test_skylines_compared(spark, monkeypatch):
    monkeypatch.setattr(grouping, "BLOCK", 7)
    r = random.Random(3)
    new, old = ([(i, r.randrange(12), r.randrange(12)) for i in range(40)] for _ in range(2))
    n, o = (spark.createDataFrame(x, "id long, a long, b long").repartition(3) for x in (new, old))
    a, b = grouping.compare_skylines(n, o, ["a", "b"])
    le = lambda x, y: x[1] <= y[1] and x[2] <= y[2]
    assert {x["id"] for x in a.collect()} == {x[0] for x in new if not any(le(y, x) for y in old)}
    assert {x["id"] for x in b.collect()} == {x[0] for x in old if not any(le(y, x) and y[1:] != x[1:] for y in new)}
    got = {x["id"] for x in grouping.skyline(n, ["a", "b"], "id").collect()}
    assert got == {x[0] for x in new if not any(le(y, x) and (y[1:] != x[1:] or y[0] < x[0]) for y in new)}


def test_edit_distances_and_float_parts():
    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        d = min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            d = min(d, slow(a[2:], b[2:]) + 1)
        return d

    r = random.Random(1)
    for _ in range(150):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(6))) for _ in range(2))
        assert text._osa(a, b, 3) == min(slow(a, b), 4)
    import pandas as pd

    p = text._parts(pd.Series([0.75, 0.0, -2.0, float("nan"), float("-inf")]))
    assert p[["numerator", "denominator"]].values.tolist() == [["3", "4"], ["0", "1"], ["-2", "1"], ["0", "0"], ["-1", "0"]]
    assert (p["mantissa"][0], p["exponent"][0], p["mantissa"][1], p["exponent"][1], p["mantissa"][2], p["exponent"][2]) == (3, -2, 0, 0, -1, 1)


@pytest.mark.parametrize("most", [1, 3])
def test_close_options_are_all_pairs_within_the_distance(spark, most):
    r = random.Random(most)
    long = "abcabcabcabcabc"
    names = {"".join(r.choice("abc") for _ in range(r.randrange(0, 12))) for _ in range(60)} | {"", "a", long, long[:7] + long[8:], "x" + long, long[::-1], long[1] + long[0] + long[2:], long[:12] + "zzz"}
    words, options = sorted(names)[::2] + [long], sorted(names)
    d = lambda rows, c: spark.createDataFrame([(x,) for x in [*rows, None, *rows[:3]]], f"{c} string")
    got = {(q["word"], q["option"]): q["distance"] for q in text.close_options(d(words, "word"), d(options, "option"), most).collect()}
    assert got == {(a, b): text._osa(a, b, most) for a in words for b in options if text._osa(a, b, most) <= most}


def test_what_the_sinks_write_is_read_again(spark, tmp_path):
    names = [("a", "x\ny"), ("b", ""), ("c", "\n\nz")]
    files.write_whole_texts(spark.createDataFrame(names, "name string, text string"), f"{tmp_path}/texts")
    assert sorted(map(tuple, files.read_named_texts(spark, f"{tmp_path}/texts").collect())) == [(n, t + "\n") for n, t in names]
    lines = lambda name: [r["value"] for r in spark.read.text(f"{tmp_path}/{name}").withColumn("f", F.input_file_name()).orderBy("f", F.monotonically_increasing_id()).collect()]
    files.write_dot(spark.createDataFrame([(2, "two"), (1, "one")], "id long, label string"), spark.createDataFrame([(2, 1)], "src long, dst long"), f"{tmp_path}/dot")
    assert lines("dot") == ["digraph dependencies {", '   m1[label="one"];', '   m2[label="two"];', "   m2 -> m1;", "}"]
    rows = spark.createDataFrame([(1, 5, 7, "n", ["k"], None, True, None), (1, 2, 4, None, None, "note", None, "s")], "grp long, start long, end long, aspect string, others array<string>, note string, flag boolean, site string")
    files.write_annotations(rows, f"{tmp_path}/json")
    assert lines("json") == ['{"range":[2,4],"atoms":[],"tokenBased":false,"note":"note","definitionSite":"s"}', '{"range":[5,7],"atoms":["n","k"],"tokenBased":true}']
    issues = spark.createDataFrame([(3, "three", False, "listed"), (4, "four", True, "listed"), (5, "five", False, "listed"), (6, "six", False, "other")], "number long, title string, is_pr boolean, outcome string")
    files.write_issue_list(issues, "http://x", f"{tmp_path}/md")
    assert lines("md") == ["- [Issue #5](http://x/issues/5): five", "- [Issue #3](http://x/issues/3): three", "- [PR #4](http://x/pull/4): four"]


def test_empty_inputs(spark):
    e = spark.createDataFrame([], E)
    ids = spark.createDataFrame([], "id long")
    assert graph.common_successors(e, ids).collect() == [] and graph.dense_ids(ids, "id").collect() == []
    assert paths.closure(e, MIN_PLUS).collect() == [] and paths.strong_components(e, ids).collect() == [] and paths.transitive_reduction(e).collect() == []
    r = spark.createDataFrame([], R)
    assert intervals.overlay(r).collect() == [] and intervals.subtract(r, r).collect() == []
    assert hierarchy.compress(spark.createDataFrame([], "path array<string>, value long")).collect() == []


def test_running_bills_over_several_batches(spark, tmp_path):
    schema = "stream string, ms long, account string, reset boolean"
    batches = [[("s", 0, "a", False), ("s", 10, "b", False)], [("s", 5, "late", False), ("s", 30, None, False)], [("s", 50, "a", False), ("s", 60, None, True)], [("s", 70, "a", False), ("s", 75, "b", False)]]
    src = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.running_bills(spark.readStream.schema(schema).parquet(src))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    sums = {r["account"]: r["ms"] for r in got.where("account is not null").groupBy("account").agg(F.sum("ms").alias("ms")).collect()}
    assert sums == {"a": 15, "b": 20} and got.agg(F.sum("late")).first()[0] == 1


def test_written_rounds_are_deleted(spark, tmp_path):
    import os

    from tessera.sources import tables

    folder = tables.shared_dir(spark).removeprefix("file:")
    tables.clean(spark)
    before = set(os.listdir(folder))
    a, b = tables.materialize(spark.range(3)), tables.materialize(spark.range(4))
    assert a.count() == 3 and len(set(os.listdir(folder)) - before) == 2
    tables.release(a)
    tables.clean(spark)
    assert set(os.listdir(folder)) == before
