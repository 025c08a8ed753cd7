"""Iterative graph operators: rounds of joins and groupings.

Every round's new rows are written to the shared folder, so the lineage stays short and a lost
executor costs one round; what was found before stays in tables that are merged as they age (Grown), so no row is
rewritten more than log(rounds) times and no round reads more than about as many tables. The
driver sees one emptiness check or count a round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semiring import BOOLEAN, MIN_PLUS, Semiring
from ..sources.tables import Grown, bucketed, materialize, materialize_counting, release, undealt
from .chains import follow
from .components import connected_components
from .graph import build_with, dense_ids, transpose


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _plain(edges: DataFrame) -> DataFrame:
    """Every edge(src, dst) once, written; what comes from here is not written again."""
    if getattr(edges, "_tessera_plain", False):
        return edges
    e = materialize(edges.select("src", "dst").distinct())
    e._tessera_plain = True
    return e


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, hops): nodes reachable from starts(id), the starts included with 0 hops."""
    e = materialize(edges.select("src", "dst").distinct())
    last = materialize(starts.select("id").distinct().withColumn("hops", F.lit(0)))
    found, hops = Grown(last), 0
    while True:
        hops += 1
        nxt = last.select(F.col("id").alias("src")).join(e, "src").select(F.col("dst").alias("id")).distinct()
        last = materialize(nxt.join(found.view().select("id"), "id", "left_anti").withColumn("hops", F.lit(hops)))
        if last.isEmpty():
            return found.view()
        found.add(last)


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, hops, path): a shortest path (its nodes, start first) to every reached node, of ties the smallest."""
    e = materialize(edges.select("src", "dst").distinct())
    last = materialize(starts.select("id").distinct().select("id", F.lit(0).alias("hops"), F.array("id").alias("path")))
    found, hops = Grown(last), 0
    while True:
        hops += 1
        step = last.withColumnRenamed("id", "src").join(e, "src").select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("id").agg(F.min("path").alias("path")).join(found.view().select("id"), "id", "left_anti")
        last = materialize(step.select("id", F.lit(hops).alias("hops"), "path"))
        if last.isEmpty():
            return found.view()
        found.add(last)


def walk_satisfying(edges: DataFrame, every: Column, some: Column, source: Column, target: Column) -> DataFrame:
    """(walk): nodes of a shortest walk from source to target of one edge or more, all of whose edges satisfy
    every and one or more satisfies some; no row if there is none. Of ties the smallest walk."""
    e = materialize(edges.where(every))
    one = edges.sparkSession.range(1)
    there = shortest_paths(e, one.select(source.alias("id")))
    back = shortest_paths(transpose(e), one.select(target.alias("id")))
    a = there.select(F.col("id").alias("src"), F.col("hops").alias("h1"), F.col("path").alias("p1"))
    b = back.select(F.col("id").alias("dst"), F.col("hops").alias("h2"), F.reverse("path").alias("p2"))
    walks = e.where(some).join(a, "src").join(b, "dst").select((F.col("h1") + F.col("h2") + 1).alias("n"), F.concat("p1", "p2").alias("walk"))
    return walks.groupBy().agg(F.min(F.struct("n", "walk")).alias("best")).where("best is not null").select("best.walk")


def product_along(walk: DataFrame, edges: DataFrame, semiring: Semiring) -> DataFrame:
    """(walk, product): labels along each walk multiplied in order."""
    steps = walk.select("walk", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("walk") - 1), lambda i: F.struct(F.element_at("walk", i).alias("src"), F.element_at("walk", i + 1).alias("dst")))).alias("i", "e"))
    labels = steps.select("walk", "i", "e.src", "e.dst").join(edges, ["src", "dst"]).groupBy("walk").agg(F.sort_array(F.collect_list(F.struct("i", "label"))).alias("a"))
    rest = F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0)))
    return labels.select("walk", F.aggregate(rest, F.col("a")[0]["label"], lambda acc, x: semiring.times(acc, x["label"])).alias("product"))


def bounded_walks(edges: DataFrame, source: Column, target: Column, cases: list[tuple[Column, Column]], semiring: Semiring) -> DataFrame:
    """(walk, product) for each case (every, some) that some walk from source to target meets; smallest first case
    only: the product of the labels of a walk that meets a bound."""
    found = _union([walk_satisfying(edges, every, some, source, target).withColumn("case", F.lit(i)) for i, (every, some) in enumerate(cases)])
    first = found.groupBy().agg(F.min_by("walk", "case").alias("walk")).where("walk is not null")
    return product_along(materialize(first), edges, semiring)


class _Known(Grown):
    """Keys with the best labels so far, in parts that are dealt by key as they lie; the label of a later part is the better one."""

    def __init__(self, first: DataFrame, *keys: str):
        super().__init__(first)
        self.keys = keys

    def merged(self, parts: list[DataFrame]) -> DataFrame:
        return bucketed(_union([undealt(d) for d in parts]).groupBy(*self.keys).agg(F.max_by("label", "round").alias("label"), F.max("round").alias("round")), *self.keys, dealt=True)

    def view(self) -> DataFrame:
        return _union([undealt(d) for d, _ in self.parts])

    def labels_of(self, pairs: DataFrame) -> DataFrame:
        """pairs(keys, ..) with _was, the label known so far or null; the parts stay where they are."""
        names = []
        for i, (part, _) in enumerate(reversed(self.parts)):
            names.append(f"_was{i}")
            pairs = pairs.join(part.select(*self.keys, F.col("label").alias(names[-1])), list(self.keys), "left")
        return pairs.withColumn("_was", F.coalesce(*names)).drop(*names)


def closure(edges: DataFrame, semiring: Semiring = MIN_PLUS, rounds: int | None = None) -> DataFrame:
    """(src, dst, label, round): the non-reflexive closure over an idempotent semiring, semi-naive: only pairs whose
    label improved in a round are extended in the next. round is the last in which the label changed.

    Edges lie in buckets by src, known pairs in buckets by src and dst, so a round shuffles what the last round improved and what
    it leads to, not what is known. rounds bounds the rounds (a negative cycle under min-plus never ends by itself).
    """
    assert semiring.idempotent, "a closure by rounds needs an idempotent plus; use levels() sums on acyclic graphs"
    e = materialize(build_with(edges, semiring.plus))
    by_src = bucketed(e.select(F.col("src").alias("_m"), "dst", F.col("label").alias("_b")), "_m")
    delta = bucketed(e.select("src", "dst", "label", F.lit(0).alias("round")), "src", "dst")
    found = _Known(delta, "src", "dst")
    i = 0
    while rounds is None or i < rounds:
        i += 1
        step = _extended(delta, by_src, semiring)
        both = found.labels_of(step).select("src", "dst", "_was", F.explode(F.when(F.col("_was").isNull(), F.array("label")).otherwise(F.array("label", "_was"))).alias("label"))
        new = both.groupBy("src", "dst").agg(semiring.plus(F.col("label")).alias("label"), F.any_value("_was").alias("_was"))
        delta, n = bucketed(new.where(~F.col("label").eqNullSafe(F.col("_was"))).select("src", "dst", "label", F.lit(i).alias("round")), "src", "dst", dealt=True, counted=F.lit(True))
        if not n:
            break
        found.add(delta)
    return found.view().groupBy("src", "dst").agg(semiring.plus(F.col("label")).alias("label"), F.max("round").alias("round"))


def _extended(pairs: DataFrame, by_src: DataFrame, semiring: Semiring) -> DataFrame:
    """pairs one edge longer; by_src(_m, dst, _b)."""
    step = pairs.select("src", F.col("dst").alias("_m"), F.col("label").alias("_a")).join(by_src, "_m")
    return step.select("src", "dst", semiring.times(F.col("_a"), F.col("_b")).alias("label")).groupBy("src", "dst").agg(semiring.plus(F.col("label")).alias("label"))


def bottom_up(e: DataFrame, sinks: DataFrame, name: str, over: Column, aggregates: dict, own: Callable[[dict], dict]) -> DataFrame:
    """The rows of sinks(id, ..), and one for each node all of whose targets along e(src, dst, ..) have got theirs, in that order.

    over: the value that an edge hands on as name, of the target's columns and e's; aggregates: how every column of sinks is
    put together from those of the targets (aggregate functions that may be applied in parts); own: the node's columns from that.
    A node's open targets are not counted down in a table of all nodes: each round logs how many targets came, and what they gave, for
    the nodes it touched, so what is written is linear in the edges. The log is merged as it ages; finished nodes leave it then."""
    degree = materialize(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_open")))
    put = [f(c).alias(c) for c, f in aggregates.items()]
    last, log, found, n = materialize(sinks), None, [], 1
    while n:
        found.append(last)
        step = last.withColumnRenamed("id", "dst").join(e, "dst").withColumn(name, over)
        step = step.select(F.col("src").alias("id"), F.lit(1).cast("long").alias("_came"), F.lit(0).cast("long").alias("_before"), *aggregates)
        if log:
            step = step.unionByName(log.view().where("not _done").select("id", F.lit(0).cast("long").alias("_came"), F.col("_came").alias("_before"), *aggregates))
        step = step.groupBy("id").agg(F.sum("_came").alias("_now"), F.max("_before").alias("_before"), *put).where("_now > 0")
        touched = step.join(degree, "id").withColumn("_came", F.col("_now") + F.col("_before")).withColumn("_done", F.col("_came") == F.col("_open")).drop("_open", "_now", "_before")
        touched, n = materialize_counting(touched, F.col("_done"))
        last = touched.where("_done").select("id", *[own(c).alias(c) for c in aggregates])
        if log:
            log.add(touched)
        else:
            log = _Log(touched, aggregates)
    return _union(found)


class _Log(Grown):
    """What the touched nodes have got so far; of a node's rows the latest holds all, and a finished node isn't touched again."""

    def __init__(self, first: DataFrame, aggregates: dict):
        super().__init__(first)
        self.aggregates = {"_came": F.max, **aggregates, "_done": F.bool_or}

    def drop(self, part: DataFrame) -> None:
        """Its finished nodes are still wanted."""

    def merged(self, parts: list[DataFrame]) -> DataFrame:
        return materialize(_union(parts).groupBy("id").agg(*[f(c).alias(c) for c, f in self.aggregates.items()]).where("not _done"))


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, level): level of a node of an acyclic graph, 0 for nodes without outgoing edges, else one more than the
    highest level among its targets, so that edge (x, y) puts y before x. Nodes on or above a cycle are not in the
    result.

    Chains of nodes with one target each are followed first, by doubling, and become one edge with their length; rounds and writes
    are those of the graph that is left (bottom_up)."""
    e = _plain(edges)
    ids = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id")))
    ids = (ids if nodes is None else ids.union(nodes.select("id"))).distinct()
    out = materialize(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("to")))
    chains = follow(out.where("n = 1").select("id", "to"), name_circles=False)
    ended = materialize(chains.ended)
    short = e.join(out.where("n > 1").select(F.col("id").alias("src")), "src", "left_semi").join(ended.withColumnRenamed("id", "dst"), "dst", "left")
    short = short.select("src", F.coalesce("root", "dst").alias("dst"), (F.coalesce("dist", F.lit(0)) + 1).alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    sinks = ids.join(out.select("id"), "id", "left_anti").withColumn("level", F.lit(0).cast("long"))
    high = materialize(bottom_up(materialize(short), sinks, "level", F.col("level") + F.col("w"), {"level": F.max}, F.col))
    chained = ended.join(high.withColumnRenamed("id", "root"), "root").select("id", (F.col("level") + F.col("dist")).alias("level"))
    return high.union(chained).select("id", F.col("level").cast("int").alias("level"))


def topological_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """levels(), or ValueError if the graph has a cycle. Order by (level, id)."""
    out = levels(edges, nodes)
    if not edges.select(F.col("src").alias("id")).join(out, "id", "left_anti").isEmpty():
        raise ValueError("no topological order: the graph has a cycle")
    return out


def is_acyclic(edges: DataFrame) -> bool:
    return edges.select(F.col("src").alias("id")).join(levels(edges), "id", "left_anti").isEmpty()


#: Steps that marks travel between two writes.
HOPS = 3


#: Times that chains are contracted before marks are sent, forwards and backwards in turn.
TURNS = 3


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp, cyclic): strongly connected components, named by their smallest node. Singletons without a
    self-loop are not cyclic.

    Nodes with one successor are contracted into the end of their chain first, by pointer doubling, then nodes with one predecessor; long
    chains and all that hangs on a circle are so done with in log(length) rounds. What is left is marked."""
    e = materialize(edges.select("src", "dst").distinct())
    loops = e.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("_loop"))
    every = nodes.select(F.col("id").alias("node")).union(e.select("src")).union(e.select("dst")).distinct()
    found = materialize(_contracted(materialize(e.where("src <> dst")), TURNS))
    name = found.groupBy("comp").agg(F.min("node").alias("_name"))  # a contracted node may be the smallest
    own = every.join(found.join(name, "comp").select("node", F.col("_name").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    own = materialize(own)
    size = own.groupBy("comp").count()
    return own.join(size, "comp").join(loops, "node", "left").select("node", "comp", ((F.col("count") > 1) | F.col("_loop").isNotNull()).alias("cyclic"))


def _contracted(live: DataFrame, turns: int) -> DataFrame:
    """(node, comp) of components of the edges live, of two nodes or more at least; live has no self-loops.

    A node with one successor is in the component of its chain's root if an edge from there enters the chain at the node or before
    it, and else alone; nodes that lead to a circle of such nodes are alone, and the circle is a component."""
    if not turns:
        return _marked(live)
    nxt, n = materialize_counting(live.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1").select("id", "to"), F.lit(True))
    if not n:
        return _contracted(transpose(live), turns - 1)
    chains = follow(nxt)
    ended, gone = materialize(chains.ended), materialize(chains.endless)
    rest = live.join(nxt.select(F.col("id").alias("src")), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    rest = materialize(rest.join(ended.select(F.col("id").alias("dst"), "root"), "dst", "left"))
    inner = materialize(_contracted(materialize(rest.select("src", F.coalesce("root", "dst").alias("dst")).where("src <> dst").distinct()), turns - 1))
    # entries of chains from the component of their root; the roots are alone if inner has no row for them
    enter = rest.where("root is not null").join(inner.select(F.col("node").alias("src"), F.col("comp").alias("_a")), "src", "left").join(inner.select(F.col("node").alias("root"), F.col("comp").alias("_b")), "root", "left")
    reached = materialize(enter.where(F.coalesce("_a", "src") == F.coalesce("_b", "root")).select(F.col("dst").alias("id"), F.coalesce("_b", "root").alias("comp")).distinct())
    if not reached.isEmpty():
        for jump in chains.jumps:
            reached = materialize(reached.union(reached.join(jump, "id").select("to", "comp")).distinct())
    own = reached.select(F.col("comp").alias("node"), "comp").distinct().join(inner.select("node"), "node", "left_anti")  # roots that were alone
    return _union([inner, reached.select(F.col("id").alias("node"), "comp"), own, chains.circles.select(F.col("id").alias("node"), "comp")])


def _marked(live: DataFrame) -> DataFrame:
    """(node, comp): components of the edges live, without self-loops.

    Every node gets the smallest node that reaches it and the smallest that it reaches, both in the same rounds, which also take
    the marks of the marks (what reaches my mark reaches me), so marks travel far in few rounds. Where both are the same node, it is
    the component's name. Edges between nodes of different marks join no component and go; what is left is marked anew."""
    done = []
    while not live.isEmpty():
        # either direction is a kind of step and of mark
        steps = materialize(live.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(x).alias("at"), F.col(y).alias("to")) for k, x, y in ((0, "src", "dst"), (1, "dst", "src"))])).alias("x")).select("x.*"))
        marks = held = materialize(steps.select("kind", F.col("to").alias("id"), F.col("to").alias("m")).union(steps.select("kind", "at", "at")).distinct())
        changed = 1
        while changed:
            old = marks.select("kind", "id", F.col("m").alias("was"))
            for _ in range(HOPS):
                hop = marks.withColumnRenamed("id", "at").join(steps, ["kind", "at"]).select("kind", F.col("to").alias("id"), "m")
                marks = marks.union(hop).groupBy("kind", "id").agg(F.min("m").alias("m"))
            over = marks.select("kind", F.col("id").alias("m"), F.col("m").alias("further"))
            new = marks.join(over, ["kind", "m"]).select("kind", "id", F.least("m", "further").alias("m")).join(old, ["kind", "id"])
            new, changed = materialize_counting(new, F.col("m") < F.col("was"))
            release(held)
            held, marks = new, new.drop("was")
        both = marks.where("kind = 0").select("id", F.col("m").alias("f")).join(marks.where("kind = 1").select("id", F.col("m").alias("b")), "id", "full")
        both = materialize(both.select("id", F.coalesce("f", "id").alias("f"), F.coalesce("b", "id").alias("b")))
        done.append(both.where("f = b").select(F.col("id").alias("node"), F.col("f").alias("comp")))
        a, b = both.toDF("src", "f", "b"), both.toDF("dst", "f", "b")
        rest = materialize(live.join(a, "src").join(b, ["dst", "f", "b"]).where("f <> b").select("src", "dst"))
        for used in (held, steps):
            release(used)
        live = rest
    return _union(done) if done else live.select(F.col("src").alias("node"), F.col("dst").alias("comp"))


def component_order(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(comp, level, place): components in reverse topological order, sinks first: if an edge leads from one to another, the other has the lower
    level and place. Places are 0, 1, .. by level, then name."""
    c = components.select("comp").distinct()
    at = levels(condensation(edges, components), c.withColumnRenamed("comp", "id")).select(F.struct("level", F.col("id").alias("comp")).alias("k"))
    return dense_ids(at, "k", "place").select("k.comp", "k.level", "place")


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst): the acyclic graph of components, self edges dropped."""
    a = components.select(F.col("node").alias("src"), F.col("comp").alias("cs"))
    b = components.select(F.col("node").alias("dst"), F.col("comp").alias("cd"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").where("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()


def component_reach(edges: DataFrame, components: DataFrame, comp: Column) -> DataFrame:
    """(id): nodes reachable from a component; an acyclic singleton doesn't reach itself."""
    c = materialize(components)
    root = c.where(F.col("comp") == comp)
    reached = reachable(condensation(edges, c), root.select(F.col("comp").alias("id")).distinct()).select(F.col("id").alias("comp"))
    return c.join(reached, "comp").where(~((F.col("comp") == comp) & ~F.col("cyclic"))).select(F.col("node").alias("id"))


def longest_paths(edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(src, dst, length, paths): for each reachable pair of an acyclic graph, (n, n) with length 0 included, the longest length
    and the number of longest paths. ValueError on a cycle. ends(id): the pairs with these targets only.

    Sources are taken by level, from the sinks upwards: when a level is reached all pairs from the targets of its nodes are final, so
    one row for each pair is made, once, whatever the lengths of its walks."""
    e = _plain(edges)
    at = materialize(topological_order(e))
    by_level = materialize(e.select("src", F.col("dst").alias("_m")).join(at.select(F.col("id").alias("src"), "level"), "src"))
    own = at if ends is None else materialize(at.join(ends.select("id").distinct(), "id", "left_semi"))
    own = own.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("length"), F.lit(1).cast("long").alias("paths"), "level")
    found = Grown(materialize(own.where("level = 0").drop("level")))
    for level in range(1, (at.agg(F.max("level")).first()[0] or 0) + 1):
        step = by_level.where(F.col("level") == level).select("src", "_m").join(found.view().withColumnRenamed("src", "_m"), "_m")
        step = step.groupBy("src", "dst", "length").agg(F.sum("paths").alias("paths")).groupBy("src", "dst").agg((F.max("length") + 1).alias("length"), F.max_by("paths", "length").alias("paths"))
        found.add(materialize(step.unionByName(own.where(F.col("level") == level).drop("level"))))
    return found.view()


def longest_path_lists(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, path): all longest paths, as arrays of nodes, between the ends of pairs(src, dst) of an acyclic graph. ValueError on a cycle.

    Lengths are found to the ends of pairs only. The edges that shorten them by one are walked from the longest pairs down, so only nodes on a
    longest path of a pair are kept, then the paths are built up from their ends: those from a node are made once, for all sources above it."""
    e = _plain(edges)
    wanted = materialize(pairs.select("src", "dst").distinct())
    far = materialize(longest_paths(e, wanted.select(F.col("dst").alias("id"))).select("src", "dst", "length"))
    most = far.agg(F.max("length")).first()[0] or 0
    ahead = far.select(F.col("src").alias("_to"), "dst", F.col("length").alias("_n"))
    steps = e.withColumnRenamed("dst", "_to").join(ahead, "_to").join(far, ["src", "dst"]).where("_n = length - 1").select("src", "_to", "dst", "length")
    steps = materialize(steps)
    by_length = {n: steps.where(F.col("length") == n) for n in range(1, most + 1)}
    every = far.join(wanted, ["src", "dst"], "left_anti").isEmpty()  # no node that leads to an end is left out
    if not every:
        asked = materialize(wanted.join(far, ["src", "dst"]))
        last = asked.where(F.col("length") == most).select("src", "dst")
        for n in range(most, 0, -1):
            by_length[n] = materialize(by_length[n].join(last, ["src", "dst"], "left_semi"))
            last = by_length[n].select(F.col("_to").alias("src"), "dst").union(asked.where(F.col("length") == n - 1).select("src", "dst"))
    found = [far.where("length = 0").select("src", "dst", F.array("dst").alias("path"))]
    for n in range(1, most + 1):
        ahead = found[-1].withColumnRenamed("src", "_to")
        paths = by_length[n].join(ahead, ["_to", "dst"]).select("src", "dst", F.concat(F.array("src"), "path").alias("path"))
        found.append(materialize(paths) if n < most else paths)  # nothing is built on the longest ones
    return _union(found) if every else _union(found).join(wanted, ["src", "dst"], "left_semi")


#: Labellings of the index of reachability.
LABELS = 8


def reach_index(edges: DataFrame, labels: int = LABELS) -> DataFrame:
    """(id, level, lo0, hi0, lo1, ..) of the nodes of an acyclic graph: an index that tells most pairs that are not connected apart without a walk.

    Every node has a number in each labelling (a hash); lo and hi are the least and greatest number of all that it reaches, itself
    included, gathered from the sinks upwards. If x reaches y, the intervals of x contain those of y in all labellings and its level is higher.
    Nodes on or above a cycle are left out."""
    e = materialize(edges.select("src", "dst").distinct())
    number = {f"{end}{i}": F.xxhash64("id", F.lit(i)) for i in range(labels) for end in ("lo", "hi")}
    sinks = e.select(F.col("dst").alias("id")).distinct().join(e.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(0).cast("long").alias("level"), *[n.alias(c) for c, n in number.items()])

    def own(c: str) -> Column:
        return F.col(c) if c == "level" else (F.least if c[:2] == "lo" else F.greatest)(F.col(c), number[c])

    return materialize(bottom_up(e, sinks, "level", F.col("level") + 1, {"level": F.max} | {c: F.min if c[:2] == "lo" else F.max for c in number}, own))


def _may_reach(x: str, y: str, labels: int = LABELS) -> Column:
    """Whether the index lets a node reach another; x and y come before the names of its columns."""
    inside = [(F.col(f"{x}lo{i}") <= F.col(f"{y}lo{i}")) & (F.col(f"{x}hi{i}") >= F.col(f"{y}hi{i}")) for i in range(labels)]
    return reduce(lambda a, b: a & b, inside, F.col(f"{x}level") > F.col(f"{y}level"))


def transitive_reduction(edges: DataFrame, acyclic: bool = False) -> DataFrame:
    """Edges of an acyclic graph without a longer path between their ends. ValueError on a cycle; acyclic: the caller knows that there
    is none.

    Edge (u, v) goes if another target w of u reaches v. Where no target of u above v's level has an interval around v's, labels decide (a running
    minimum over the targets of u, which are sorted in one task). For what is left a walk starts at each w whose labels contain v's, and goes on only over such nodes, until it is at v."""
    e = materialize(edges.select("src", "dst").distinct())
    index = reach_index(e)
    if not acyclic and not e.select(F.col("src").alias("id")).join(index, "id", "left_anti").isEmpty():
        raise ValueError("no transitive reduction: the graph has a cycle")
    columns = [c for c in index.columns if c != "id"]
    at = bucketed(e.join(index.withColumnRenamed("id", "dst"), "dst").select("src", "dst", *columns), "src")
    above = W.partitionBy("src").orderBy(F.desc("level")).rangeBetween(W.unboundedPreceding, -1)
    maybe = reduce(lambda a, b: a & b, [F.min(f"lo{i}").over(above) <= F.col(f"lo{i}") for i in range(LABELS)] + [F.max(f"hi{i}").over(above) >= F.col(f"hi{i}") for i in range(LABELS)])
    open_ = materialize(at.withColumn("_maybe", maybe).where("_maybe").drop("_maybe"))
    goal = ["src", "dst", *columns]
    live = open_.join(at.select("src", F.col("dst").alias("_x"), *[F.col(c).alias(f"x_{c}") for c in columns]), "src").where(_may_reach("x_", "")).select(*goal, "_x")
    n, hits = 1, []
    while n:
        step = live.join(at.select(F.col("src").alias("_x"), F.col("dst").alias("_y"), *[F.col(c).alias(f"y_{c}") for c in columns]), "_x")
        step = step.withColumn("_hit", F.col("_y") == F.col("dst")).where(F.col("_hit") | _may_reach("y_", "")).select(*goal, F.col("_y").alias("_x"), "_hit").distinct()
        step, n = materialize_counting(step, ~F.col("_hit"))
        hits.append(step.where("_hit").select("src", "dst"))
        live = step.where("not _hit").drop("_hit").join(hits[-1], ["src", "dst"], "left_anti")
    return edges.join(_union(hits), ["src", "dst"], "left_anti").select(*edges.columns)


def drop_nodes_keep_paths(edges: DataFrame, keep: DataFrame, semiring: Semiring, acyclic: bool = False) -> DataFrame:
    """Remove the nodes of an acyclic graph that are not in keep(id); kept nodes are connected by the semiring sum
    over all paths through removed nodes of the products of their labels. ValueError on a cycle; acyclic: the
    caller knows that there is none."""
    e = materialize(build_with(edges, semiring.plus))
    if not acyclic:
        topological_order(e)
    kept = materialize(keep.select("id").distinct())
    to_kept = lambda d: d.join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "label")
    to_gone = lambda d: d.join(kept.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "label")
    walk = materialize(e.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "label"))
    found = []
    while not walk.isEmpty():
        found.append(to_kept(walk))
        step = to_gone(walk).select("src", F.col("dst").alias("_m"), F.col("label").alias("_a")).join(e.select(F.col("src").alias("_m"), "dst", F.col("label").alias("_b")), "_m")
        walk = materialize(step.groupBy("src", "dst").agg(semiring.plus(semiring.times(F.col("_a"), F.col("_b"))).alias("label")))
    return build_with(_union(found), semiring.plus) if found else walk


def cluster(items: DataFrame, item: str, keys: str) -> DataFrame:
    """(item, cluster): items that share a key, directly or over others, get one cluster, named by its smallest item. keys is an
    array; an item without keys is alone. Null keys don't join. Items are linked to the least item of each key, so
    a very frequent key costs one link an item."""
    pairs = items.select(F.col(item).alias("i"), F.explode(keys).alias("k")).where("k is not null")
    least = pairs.groupBy("k").agg(F.min("i").alias("m"))
    links = pairs.join(least, "k").select(F.col("i").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
    comp = connected_components(links).withColumnRenamed("node", item)
    return items.select(item).distinct().join(comp, item, "left").select(item, F.coalesce("component", item).alias("cluster"))


def constraint_forest(edges: DataFrame, flexible: DataFrame) -> DataFrame:
    """edges with tree: edges that share a flexible node, directly or over others, get one tree, named by its smallest flexible
    node; an edge without one is a tree of its own (null). Rigid nodes don't join."""
    flex = flexible.select("id").distinct()
    a = flex.select(F.col("id").alias("src"), F.col("id").alias("_a"))
    b = flex.select(F.col("id").alias("dst"), F.col("id").alias("_b"))
    e = materialize(edges.join(a, "src", "left").join(b, "dst", "left"))
    comp = connected_components(e.where("_a is not null and _b is not null").select(F.col("_a").alias("src"), F.col("_b").alias("dst")))
    comp = comp.withColumnRenamed("node", "_n")
    out = e.withColumn("_n", F.coalesce("_a", "_b")).join(comp, "_n", "left")
    return out.select(*edges.columns, F.coalesce("component", "_n").alias("tree"))


def difference_constraints(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closure, negative loops): tightest offsets of x - y <= label by min-plus closure, in as many rounds as there are nodes,
    and the nodes on a negative loop (none: the constraints are consistent)."""
    n = edges.select("src").union(edges.select("dst")).distinct().count()
    out = materialize(closure(edges, MIN_PLUS, rounds=max(1, n)))
    return out.drop("round"), out.where("src = dst and label < 0").select(F.col("src").alias("id"))


def forced_to_infinity(edges: DataFrame) -> DataFrame:
    """(id): nodes with x + n <= x, a loop of a label below zero in the closure."""
    return difference_constraints(edges)[1]


def consistent_offsets(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offsets, loops) of the constraints dst - src <= label. offsets(id, value): the greatest values of at most 0 that satisfy them all; no rows if there
    are none. loops(loop, place, id): then, loops of a negative sum, in the order of their edges from the smallest node on, which names the loop.

    Values are relaxed from a virtual source with an edge of 0 to every node, and only nodes whose value fell are relaxed from in the next round. Each
    node keeps the one that its value came from. A circle of these predecessors is a negative loop, and there is one soon after a loop
    has been gone round; they are followed by doubling after 1, 2, 4, .. rounds, so a loop is found in about twice its rounds."""
    e = build_with(edges, F.min)
    by_src = bucketed(e.select(F.col("src").alias("_m"), F.col("dst").alias("id"), F.col("label").alias("_w")), "_m")
    zero = F.struct(F.lit(0).cast(edges.schema["label"].dataType).alias("value"), F.lit(None).cast(edges.schema["src"].dataType).alias("from")).alias("label")
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    delta = bucketed(nodes.select("id", zero, F.lit(0).alias("round")), "id")
    found, i, look, n = _Known(delta, "id"), 0, 1, 1
    none = delta.where("false").select(F.col("id").alias("loop"), F.lit(0).cast("long").alias("place"), "id")
    while True:
        i += 1
        step = delta.select(F.col("id").alias("_m"), F.col("label.value").alias("_v")).join(by_src, "_m").groupBy("id").agg(F.min(F.struct((F.col("_v") + F.col("_w")).alias("value"), F.col("_m").alias("from"))).alias("label"))
        better = found.labels_of(step).where("label.value < _was.value").select("id", "label", F.lit(i).alias("round"))
        delta, n = bucketed(better, "id", dealt=True, counted=F.lit(True))
        now = lambda: found.view().groupBy("id").agg(F.max_by("label", "round").alias("label"))
        if not n:
            return materialize(now().select("id", "label.value")), none
        found.add(delta)
        if i == look:
            look *= 2
            back = materialize(now().where("label.from is not null").select("id", F.col("label.from").alias("to")))
            circles = materialize(follow(back).circles)
            if not circles.isEmpty():
                # cut open at the smallest node, whose predecessor the last of the loop then is
                open_ = back.join(circles.where("id <> comp"), "id").select("id", "to")
                places = follow(open_, name_circles=False).ended.select("id", F.col("root").alias("loop"), F.col("dist").alias("place"))
                first = circles.where("id = comp").select("comp", F.lit(0).cast("long").alias("place"), "id")
                return delta.where("false").select("id", "label.value"), materialize(first.unionByName(places.select(F.col("loop").alias("comp"), "place", "id")).withColumnRenamed("comp", "loop"))
