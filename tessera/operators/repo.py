"""Build and repository analytics: versions, libraries, liveness, staleness, changelogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .graph import dense_ids
from .paths import drop_nodes_keep_paths, levels, reachable, transitive_reduction
from ..functions.semiring import BOOLEAN

#: Fixed value: a name, a hyphen and numbers between dots.
VERSIONED = r"^(.*)-([0-9]+(?:\.[0-9]+)*)$"


def parse_version_name(name: Column) -> tuple[Column, Column]:
    """(base, version): "foo-01.2" is foo and [1, 2]; other names have no version (an empty array). Parts are strings without leading
    zeros, since a part may have any number of digits; order them by version_key."""
    v = F.regexp_extract(name, VERSIONED, 2)
    parts = F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.when(v != "", F.regexp_extract(name, VERSIONED, 1)).otherwise(name), F.when(v != "", parts).otherwise(F.array().cast("array<string>"))


def version_key(version: Column) -> Column:
    """Sorts as the version does: no version is highest."""
    return F.struct(F.when(F.size(version) == 0, 1).otherwise(0).alias("none"), F.transform(version, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))).alias("parts"))


def best_matches(wanted: DataFrame, libraries: DataFrame) -> DataFrame:
    """(wanted, name): for each wanted name the best of libraries(name) with its base, and its version if it gives one: the highest version,
    no version above all, with all ties."""
    wb, wv = parse_version_name(F.col("wanted"))
    lb, lv = parse_version_name(F.col("name"))
    w = wanted.select("wanted").distinct().select("wanted", wb.alias("base"), wv.alias("wv"))
    lib = libraries.select("name").select("name", lb.alias("base"), lv.alias("lv"))
    m = w.join(lib, "base").where((F.size("wv") == 0) | (F.col("wv") == F.col("lv")))
    best = m.withColumn("_r", F.rank().over(W.partitionBy("wanted").orderBy(F.desc(version_key(F.col("lv"))))))
    return best.where("_r = 1").select("wanted", "name")


def shortest_alias(aliases: DataFrame) -> DataFrame:
    """(entity, alias): of aliases(alias, entity, parts, bound_at) that name one entity only, the one of fewest parts, then the latest, then the smallest."""
    one = aliases.groupBy("alias").agg(F.count_distinct("entity").alias("n")).where("n = 1").select("alias")
    ok = aliases.join(one, "alias")
    return ok.groupBy("entity").agg(F.min_by("alias", F.struct("parts", -F.col("bound_at"), "alias")).alias("alias"))


def dictionary_encode(df: DataFrame, value: str, seq: str) -> DataFrame:
    """(value, code, fresh, reused): dense codes in the order of first sight, with how often the value was new (1) and met again."""
    g = materialize(df.groupBy(value).agg(F.min(seq).alias("_at"), F.count("*").alias("_n")))
    key = g.withColumn("_k", F.struct("_at", value))
    ids = dense_ids(key, "_k", "code")
    return key.join(ids, "_k").select(value, "code", F.lit(1).cast("long").alias("fresh"), (F.col("_n") - 1).alias("reused"))


def bimap_lookup(probes: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """probes(key) with the mapping's other columns, by key or by tag."""
    return probes.join(mapping, key, "left")


def tag_violations(mapping: DataFrame) -> DataFrame:
    """(tag, n): tags of more than one key; none if the tag is injective. Null tags don't count."""
    return mapping.where("tag is not null").groupBy("tag").agg(F.count_distinct("key").alias("n")).where("n > 1")


def bimap_insert(mapping: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new mapping, old values): rows replace entries of their key; old values of replaced keys are returned."""
    return mapping.join(rows.select("key"), "key", "left_anti").unionByName(rows), mapping.join(rows.select("key"), "key", "left_semi")


def locate(names: DataFrame, dirs: DataFrame, extensions: DataFrame, files: DataFrame) -> DataFrame:
    """(name, status, path): Found with its path if one candidate dir/name+extension exists in files(path), Ambiguous if several, NotFound if none.

    Each path is cut at its slashes and what is behind a known dir at every place, so dirs, extensions and names are all met by equality, however many."""
    cut = F.expr("explode(filter(sequence(1, length(path)), i -> substr(path, i, 1) = '/')) as _i")
    under = files.select("path").distinct().where("path <> ''").select("path", cut).select("path", F.expr("substr(path, 1, _i - 1)").alias("dir"), F.expr("substr(path, _i + 1)").alias("_rest"))
    under = under.join(dirs.select("dir"), "dir", "left_semi")
    ends = under.select("path", "_rest", F.expr("explode(sequence(0, length(_rest))) as _n")).select("path", F.expr("substr(_rest, 1, _n)").alias("name"), F.expr("substr(_rest, _n + 1)").alias("ext"))
    hit = ends.join(extensions.select("ext"), "ext", "left_semi").join(names.select("name"), "name", "left_semi").groupBy("name").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    return names.select("name").distinct().join(hit, "name", "left").select("name", F.when(F.col("n") > 1, "Ambiguous").when(F.col("n") == 1, "Found").otherwise("NotFound").alias("status"), F.when(F.col("n") == 1, F.col("path")).alias("path"))


def benchmark_summary(logs: DataFrame, measure: str, containing: str, cases: list[str]) -> DataFrame:
    """One row a log (name) with a column a case: the measure, for logs whose name holds a substring."""
    return logs.where(F.contains("log", F.lit(containing))).groupBy("log").pivot("case", cases).agg(F.max(measure))


def live_rows(items: list[DataFrame], links: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """Liveness over several item tables, each with a column tag (unique over all): rows reachable over links(src, dst) from any of roots(id)."""
    live = materialize(reachable(links, roots).select(F.col("id").alias("tag")))
    return [t.join(live, "tag", "left_semi") for t in items]


def resolve_dependencies(roots: DataFrame, libraries: DataFrame) -> DataFrame:
    """(wanted, status, name, round): a worklist of names through depends of libraries(name, depends array), each resolved by best_matches: found, not found or
    ambiguous. A name is resolved once."""
    lib = materialize(libraries.select("name", "depends"))
    todo, done = materialize(roots.select("wanted").distinct()), []
    while not todo.isEmpty():
        m = best_matches(todo, lib).groupBy("wanted").agg(F.count("*").alias("n"), F.min("name").alias("name"))
        r = todo.join(m, "wanted", "left").select("wanted", F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "found").otherwise("not found").alias("status"), F.when(F.col("n") == 1, F.col("name")).alias("name"), F.lit(len(done)).alias("round"))
        done.append(materialize(r))
        seen = reduce(DataFrame.union, done).select("wanted")
        todo = materialize(done[-1].where("status = 'found'").join(lib, "name").select(F.explode("depends").alias("wanted")).distinct().join(seen, "wanted", "left_anti"))
    return reduce(DataFrame.union, done) if done else todo.select("wanted", F.lit("").alias("status"), F.lit("").alias("name"), F.lit(0).alias("round"))


def include_paths(resolved: DataFrame, libraries: DataFrame) -> DataFrame:
    """(pos, include): "." first, then the includes of resolved libraries without repeats."""
    inc = resolved.where("status = 'found'").join(libraries, "name").select(F.explode("includes").alias("include")).where("include <> '.'").distinct()
    ids = dense_ids(inc, "include", "pos").select((F.col("pos") + 1).alias("pos"), "include")
    return ids.union(resolved.sparkSession.range(1).select(F.lit(0).cast("long"), F.lit(".")))


def dependency_report(imports: DataFrame, libraries: DataFrame, library: str = "library") -> DataFrame:
    """(src, dst): imports reduced, only modules of libraries(module) kept with their paths, and reduced again."""
    first = materialize(transitive_reduction(imports.select("src", "dst")))
    kept = drop_nodes_keep_paths(first.withColumn("label", F.lit(True)), libraries.select(F.col("module").alias("id")), BOOLEAN, acyclic=True)
    return transitive_reduction(materialize(kept.select("src", "dst")), acyclic=True)


def stale_modules(modules: DataFrame, stored: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, reason): modules whose source hash differs from the stored one or that were never stored ("source"), those with an import whose recorded hash is not its
    latest ("import"), and all that import a stale one, directly or not ("passed on")."""
    src = modules.join(stored, "module", "left").where("stored_hash is null or stored_hash <> src_hash").select("module", F.lit("source").alias("reason"), F.lit(0).alias("k"))
    latest = modules.select(F.col("module").alias("imported"), F.col("src_hash").alias("_latest"))
    imp = imports.join(latest, "imported").where("imported_hash <> _latest").select("module", F.lit("import").alias("reason"), F.lit(1).alias("k")).distinct()
    own = materialize(src.union(imp))
    edges = imports.select(F.col("imported").alias("src"), F.col("module").alias("dst"))
    reached = reachable(edges, own.select(F.col("module").alias("id"))).where("hops > 0").select(F.col("id").alias("module"), F.lit("passed on").alias("reason"), F.lit(2).alias("k"))
    return own.union(reached).groupBy("module").agg(F.min_by("reason", "k").alias("reason"))


def rebuild_order(stale: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, level): stale modules by readiness, imports before importers."""
    s = materialize(stale.select("module"))
    e = imports.join(s, "module", "left_semi").join(s.select(F.col("module").alias("imported")), "imported", "left_semi")
    return levels(e.select(F.col("module").alias("src"), F.col("imported").alias("dst")), s.select(F.col("module").alias("id"))).withColumnRenamed("id", "module")


def select_issues(issues: DataFrame, milestone: int, excluded: list[str]) -> DataFrame:
    """issues(number, title, milestone, labels, is_pr, merged, state_reason) with outcome: the first that holds of wrong milestone, not planned, unmerged PR,
    excluded label, else listed. Titles lose their trailing blanks."""
    out = (
        F.when(F.col("milestone").isNull() | (F.col("milestone") != milestone), "wrong milestone")
        .when(F.coalesce(F.col("state_reason") == "not_planned", F.lit(False)), "not planned")
        .when(F.col("is_pr") & ~F.col("merged"), "unmerged PR")
        .when(F.arrays_overlap("labels", F.array(*map(F.lit, excluded))), "excluded label")
        .otherwise("listed")
    )
    return issues.withColumn("title", F.rtrim("title")).withColumn("outcome", out)
