"""Queries of build and repository analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths, repo
from ..operators.graph import dense_ids
from ..sources import files
from ..sources.tables import materialize, table
from . import views as v
from .base import query


@query("""select name, case when regexp_matches(name, '^(.*)-([0-9]+(\\.[0-9]+)*)$') then regexp_extract(name, '^(.*)-([0-9]+(\\.[0-9]+)*)$', 1) else name end as base,
array_to_string(list_transform(string_split(regexp_extract(name, '^(.*)-([0-9]+(\\.[0-9]+)*)$', 2), '.'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')), '.') as version
from (select name from libraries union all select c_name || '-00' || c_custkey || '.010' from customer union all select p_name from part)""", "libraries")
def t6_version_names(spark, sf):
    n = v.libraries(spark, sf).select("name").union(table(spark, sf, "customer").select(F.concat("c_name", F.lit("-00"), F.col("c_custkey").cast("string"), F.lit(".010")))).union(table(spark, sf, "part").select("p_name"))
    base, version = repo.parse_version_name(F.col("name"))
    return n.select("name", base.alias("base"), F.array_join(version, ".").alias("version"))


WANTED = ", wanted as (select distinct base as wanted from libraries union select min(name) from libraries group by base union select 'nothing-1')"


def _wanted(lib):
    return lib.select(F.col("base").alias("wanted")).distinct().union(lib.groupBy("base").agg(F.min("name").alias("wanted")).select("wanted")).union(lib.sparkSession.createDataFrame([("nothing-1",)], "wanted string")).distinct()


@query(WANTED + """, l as (select name, base, cast(string_split(regexp_extract(name, '-([0-9.]+)$', 1), '.') as bigint[]) as ver from libraries),
m as (select w.wanted, l.name, rank() over (partition by w.wanted order by l.ver desc) as r from wanted w join l on w.wanted = l.base or w.wanted = l.name) select wanted, name from m where r = 1""", "libraries")
def w13_best_matches(spark, sf):
    lib = v.libraries(spark, sf)
    return repo.best_matches(_wanted(lib), lib)


@query("""select brand as entity, arg_min(alias, row(parts, -bound, alias)) as alias from (
  select alias, brand, len(string_split(alias, ' ')) as parts, max(p) as bound from (select p_brand as brand, p_partkey as p, unnest([p_name, p_name || ' ' || p_type, p_type || p_size || ' ' || p_name]) as alias from part) group by alias, brand)
where alias in (select alias from (select p_brand as brand, unnest([p_name, p_name || ' ' || p_type, p_type || p_size || ' ' || p_name]) as alias from part) group by alias having count(distinct brand) = 1) group by brand""")
def w14_shortest_alias(spark, sf):
    p = table(spark, sf, "part")
    names = F.array("p_name", F.concat("p_name", F.lit(" "), "p_type"), F.concat("p_type", F.col("p_size").cast("string"), F.lit(" "), "p_name"))
    a = p.select(F.col("p_brand").alias("entity"), "p_partkey", F.explode(names).alias("alias")).groupBy("alias", "entity").agg(F.max("p_partkey").alias("bound_at"))
    return repo.shortest_alias(a.withColumn("parts", F.size(F.split("alias", " "))))


WORDS = "select word, item_id * 100000 + k as seq from (select item_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) as k from benchmark)"


def bench_words(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("k", "word"))
    return b.select("word", (F.col("item_id") * 100000 + F.col("k") + 1).alias("seq"))


@query(f"select word, row_number() over (order by min(seq)) - 1 as code, 1 as fresh, count(*) - 1 as reused from ({WORDS}) group by word")
def w12_dictionary_encode(spark, sf):
    return repo.dictionary_encode(bench_words(spark, sf), "word", "seq")


@query("""select 'key' as side, k as probe, s_name as found from (select unnest(range(0, 30, 3)) as k) left join supplier on s_suppkey = k union all select 'tag', k, s_name from (select unnest(range(0, 30, 3)) as k) left join supplier on s_nationkey = k
union all select 'shared tag', s_nationkey, cast(count(*) as varchar) from supplier group by s_nationkey having count(*) > 1 union all select 'old', s_suppkey, s_name from supplier where s_acctbal < 0 union all select 'new', s_suppkey, case when s_acctbal < 0 then 'replaced' else s_name end from supplier""")
def j14_bimap(spark, sf):
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"), F.col("s_nationkey").cast("long").alias("tag"), "s_acctbal")
    probe = spark.range(0, 30, 3)
    row = lambda d, side, probe, found: d.select(F.lit(side).alias("side"), F.col(probe).alias("probe"), F.col(found).alias("found"))
    core = m.select("key", "value", "tag")
    new, old = repo.bimap_insert(core, m.where("s_acctbal < 0").select("key", F.lit("replaced").alias("value"), "tag"))
    a = row(repo.bimap_lookup(probe.withColumnRenamed("id", "key"), core, "key"), "key", "key", "value")
    b = row(repo.bimap_lookup(probe.withColumnRenamed("id", "tag"), core, "tag"), "tag", "tag", "value")
    c = row(repo.tag_violations(core).withColumn("n", F.col("n").cast("string")), "shared tag", "tag", "n")
    return a.union(b).union(c).union(row(old, "old", "key", "value")).union(row(new, "new", "key", "value"))


FILES = "select distinct r_name || '/' || p_brand || case when p_size > 25 then '.src' else '.lit' end as path from part join region on r_regionkey = p_size % 9"


@query(f"""select name, case when n > 1 then 'Ambiguous' when n = 1 then 'Found' else 'NotFound' end as status, case when n = 1 then p end as path from (
select name, (select count(*) from ({FILES}) f where f.path in (select r_name || '/' || b.name || e from region, (select unnest(['.src', '.lit']) as e) where r_name < 'B')) as n,
  (select min(path) from ({FILES}) f where f.path in (select r_name || '/' || b.name || e from region, (select unnest(['.src', '.lit']) as e) where r_name < 'B')) as p from (select distinct p_brand as name from part union select 'Brand#none') b)""")
def j15_locate(spark, sf):
    p, r = table(spark, sf, "part"), table(spark, sf, "region")
    f = p.join(r, F.col("r_regionkey") == F.col("p_size") % 9).select(F.concat("r_name", F.lit("/"), "p_brand", F.when(F.col("p_size") > 25, ".src").otherwise(".lit")).alias("path"))
    names = p.select(F.col("p_brand").alias("name")).union(spark.createDataFrame([("Brand#none",)], "name string"))
    return repo.locate(names.distinct(), r.where("r_name < 'B'").select(F.col("r_name").alias("dir")), spark.createDataFrame([(".src",), (".lit",)], "ext string"), f)


@query("""select o_orderpriority as log, max(o_totalprice) filter (o_orderstatus = 'F') as "F", max(o_totalprice) filter (o_orderstatus = 'O') as "O", max(o_totalprice) filter (o_orderstatus = 'P') as "P" from orders where contains(o_orderpriority, 'I') group by 1""")
def a17_benchmark_summary(spark, sf):
    logs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("log"), F.col("o_orderstatus").alias("case"), F.col("o_totalprice").alias("seconds"))
    return repo.benchmark_summary(logs, "seconds", "I", ["F", "O", "P"])


@query("""with recursive l as (select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem where l_returnflag = 'R' and l_quantity = 50 union select distinct 's' || l_suppkey, 'p' || l_partkey from lineitem where l_returnflag = 'A' and l_quantity = 1),
r(id) as (select 'p' || p_partkey from part where p_size = 50 union select l.dst from r join l on l.src = r.id) select r.id as tag, case when r.id[1] = 'p' then 'part' else 'supplier' end as kind from r""")
def g17_live_rows(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("tag"), F.lit("part").alias("kind"), "p_size")
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("tag"), F.lit("supplier").alias("kind"))
    l = table(spark, sf, "lineitem")
    a, b = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    links = l.where("l_returnflag = 'R' and l_quantity = 50").select(a.alias("src"), b.alias("dst")).union(l.where("l_returnflag = 'A' and l_quantity = 1").select(b, a)).distinct()
    live = repo.live_rows([p.drop("p_size"), s], links, p.where("p_size = 50").select(F.col("tag").alias("id")))
    return live[0].union(live[1])


LIBS = """, lib as (select base || '-' || max(name_v) as name, base, 'brand' || (cast(replace(base, 'brand', '') as bigint) * 2) as dep from (select base, regexp_extract(name, '-(.*)$', 1) as name_v from libraries) group by base)"""


def _lib(spark, sf):
    g = v.libraries(spark, sf).withColumn("v", F.regexp_extract("name", "-(.*)$", 1)).groupBy("base").agg(F.max("v").alias("v"))
    dep = F.concat(F.lit("brand"), (F.replace("base", F.lit("brand"), F.lit("")).cast("long") * 2).cast("string"))
    return g.select(F.concat("base", F.lit("-"), "v").alias("name"), "base", F.array(dep).alias("depends"), F.array("base", F.lit(".")).alias("includes"))


@query(LIBS + """, r(wanted, round) as (select 'brand1', 0 union select lib.dep, r.round + 1 from r join lib on lib.base = r.wanted)
select r.wanted, case when lib.name is null then 'not found' else 'found' end as status, lib.name, r.round from r left join lib on lib.base = r.wanted""", "libraries")
def g18_resolve_dependencies(spark, sf):
    return repo.resolve_dependencies(spark.createDataFrame([("brand1",)], "wanted string"), _lib(spark, sf))


@query(LIBS + """, r(wanted) as (select 'brand1' union select lib.dep from r join lib on lib.base = r.wanted), f as (select distinct lib.base from r join lib on lib.base = r.wanted)
select 0 as pos, '.' as include union all select row_number() over (order by base), base from f""", "libraries")
def g18_include_paths(spark, sf):
    lib = materialize(_lib(spark, sf))
    return repo.include_paths(materialize(repo.resolve_dependencies(spark.createDataFrame([("brand1",)], "wanted string"), lib)), lib)


def _longest(e: str, w: str) -> str:
    return f"{w}(src, dst, n) as (select src, dst, 1 from {e} union select {w}.src, e.dst, {w}.n + 1 from {w} join {e} e on {w}.dst = e.src)"


REPORT = f""", {_longest('dag_edges', 'w1')}, e1 as (select e.src, e.dst from dag_edges e join (select src, dst, max(n) as m from w1 group by src, dst) l on l.src = e.src and l.dst = e.dst where m = 1),
k as (select p_partkey as id from part where p_size > 10),
w2(src, dst) as (select src, dst from e1 where src in (select id from k) union select w2.src, e1.dst from w2 join e1 on w2.dst = e1.src where w2.dst not in (select id from k)), e2 as (select src, dst from w2 where dst in (select id from k)),
{_longest('e2', 'w3')}, e3 as (select e.src, e.dst from e2 e join (select src, dst, max(n) as m from w3 group by src, dst) l on l.src = e.src and l.dst = e.dst where m = 1)"""


def _report(spark, sf):
    keep = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("module"))
    return repo.dependency_report(v.dag_edges(spark, sf), keep)


@query(REPORT + " select src, dst from e3", "dag_edges")
def g19_dependency_report(spark, sf):
    return _report(spark, sf)


@query(REPORT + """, i as (select m, row_number() over (order by m) - 1 as id from (select src as m from e3 union select dst from e3))
select 0 as part, null as a, null as b, 'digraph dependencies {' as line union all select 3, null, null, '}' union all
select 1, i.id, null, '   m' || i.id || '[label="' || p_name || '"];' from i join part on p_partkey = i.m union all select 2, s.id, d.id, '   m' || s.id || ' -> m' || d.id || ';' from e3 join i s on s.m = e3.src join i d on d.m = e3.dst""", "dag_edges")
def io5_dot_text(spark, sf):
    e = materialize(_report(spark, sf))
    ids = materialize(dense_ids(e.select(F.col("src").alias("m")).union(e.select("dst")), "m", "id"))
    nodes = ids.join(table(spark, sf, "part").select(F.col("p_partkey").alias("m"), F.col("p_name").alias("label")), "m").select("id", "label")
    edges = e.join(ids.select(F.col("m").alias("src"), F.col("id").alias("a")), "src").join(ids.select(F.col("m").alias("dst"), F.col("id").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return files.dot_lines(nodes, edges)


STALE = """, own as (select m.module, 'source' as reason, 0 as k from modules m left join stored s on s.module = m.module where s.stored_hash is null or s.stored_hash <> m.src_hash
  union all select i.module, 'import', 1 from imports i join modules m on m.module = i.imported where i.imported_hash <> m.src_hash),
r(id, deep) as (select module, false from own union select i.module, true from r join imports i on i.imported = r.id),
st as (select module, arg_min(reason, k) as reason from (select * from own union all select id, 'passed on', 2 from r where deep) group by module)"""


@query(STALE + " select module, reason from st", "dag_edges modules stored imports")
def g20_stale_modules(spark, sf):
    return repo.stale_modules(v.modules(spark, sf), v.stored(spark, sf), v.imports(spark, sf))


@query(STALE + """, e as (select module as src, imported as dst from imports where module in (select module from st) and imported in (select module from st)),
lv(id, h) as (select module, 0 from st where module not in (select src from e) union select e.src, lv.h + 1 from lv join e on e.dst = lv.id) select id as module, max(h) as level from lv group by id""", "dag_edges modules stored imports")
def g20_rebuild_order(spark, sf):
    stale = materialize(repo.stale_modules(v.modules(spark, sf), v.stored(spark, sf), v.imports(spark, sf)))
    return repo.rebuild_order(stale, v.imports(spark, sf))


OUTCOME = """, c as (select number, rtrim(title) as title, is_pr, case when milestone <> 1997 then 'wrong milestone' when state_reason = 'not_planned' then 'not planned' when is_pr and not merged then 'unmerged PR'
  when list_contains(labels, 'large') or list_contains(labels, '5-LOW') then 'excluded label' else 'listed' end as outcome from issues)"""


def _selected(spark, sf):
    return repo.select_issues(v.issues(spark, sf), 1997, ["large", "5-LOW"])


@query(OUTCOME + " select number, title, is_pr, outcome from c", "issues")
def t19_select_issues(spark, sf):
    return _selected(spark, sf).select("number", "title", "is_pr", "outcome")


@query(OUTCOME + """ select cast(is_pr as integer) as part, number, '- [' || case when is_pr then 'PR' else 'Issue' end || ' #' || number || '](https://example.org/repo' || case when is_pr then '/pull/' else '/issues/' end || number || '): ' || title as line from c where outcome = 'listed'""", "issues")
def io7_issue_markdown(spark, sf):
    return files.issue_lines(_selected(spark, sf), "https://example.org/repo")
