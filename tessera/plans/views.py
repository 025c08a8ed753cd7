"""Tables that the registered queries work on, derived from the given ones: in Spark, and in SQL."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table

SQL: dict[str, str] = {}

SQL["dag_edges"] = """select src, dst, cast(max(label) as bigint) as label from (
  select p_partkey as src, p_partkey // 2 as dst, p_size as label from part union all select p_partkey, p_partkey // 3, p_size from part) where dst >= 1 and src > dst group by src, dst"""


def dag_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each part to its number halved and to a third of it."""
    p = table(spark, sf, "part")
    e = p.select(F.col("p_partkey").alias("src"), F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"))).alias("dst"), F.col("p_size").cast("long").alias("label"))
    return e.where("dst >= 1 and src > dst").groupBy("src", "dst").agg(F.max("label").alias("label"))


SQL["trade"] = """select s.s_nationkey as src, c.c_nationkey as dst, cast(round(l.l_extendedprice) as bigint) as label, l.l_orderkey * 100000000 + l.l_partkey * 1000 + l.l_linenumber as seq
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey join supplier s on l.l_suppkey = s.s_suppkey"""


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """Sales rows, supplier's nation to customer's nation."""
    l, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey)
    return j.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.round("l_extendedprice").cast("long").alias("label"), (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("seq"))


SQL["trade_edges"] = "select src, dst, cast(sum(label) as bigint) as label from trade group by src, dst"


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).groupBy("src", "dst").agg(F.sum("label").alias("label"))


SQL["next_supp"] = """select src, dst, count(*) as label from (
  select l_suppkey as src, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dst from lineitem) where dst is not null group by src, dst"""


def next_supp(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier of a line to that of the order's next line, with how often."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst"))
    return e.where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("label"))


#: Names of views that give all of next_supp for now, in this thread.
_WHOLE: ContextVar[frozenset[str]] = ContextVar("whole", default=frozenset())


@contextmanager
def whole(*names: str) -> Iterator[None]:
    """main_next, top_next or both stand for next_supp without their cap."""
    before = _WHOLE.set(_WHOLE.get() | set(names))
    try:
        yield
    finally:
        _WHOLE.reset(before)


SQL["main_next"] = """select src, dst, label from (select *, row_number() over (partition by src order by label desc, dst) as k from next_supp) where k <= 2"""


def main_next(spark: SparkSession, sf: str) -> DataFrame:
    """The two most frequent followers of each supplier."""
    if "main_next" in _WHOLE.get():
        return next_supp(spark, sf)
    e = next_supp(spark, sf).withColumn("_k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("label"), "dst")))
    return e.where("_k <= 2").drop("_k")


SQL["top_next"] = """select src, dst, label from (select *, row_number() over (partition by src order by label desc, dst) as k from next_supp) where k <= 1"""


def top_next(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent follower of each supplier."""
    if "top_next" in _WHOLE.get():
        return next_supp(spark, sf)
    return next_supp(spark, sf).groupBy("src").agg(F.min_by(F.struct("dst", "label"), F.struct(-F.col("label"), "dst")).alias("x")).select("src", "x.*")


SQL["bloc_edges"] = "select src, dst, label from next_supp where src % 7 <= dst % 7"


def bloc_edges(spark: SparkSession, sf: str) -> DataFrame:
    """next_supp among seven blocs of suppliers, without what leads to an earlier bloc."""
    return next_supp(spark, sf).where("src % 7 <= dst % 7")


SQL["flow_edges"] = """select src, dst, count(*) as label from (select lag(event_type) over (partition by user_id order by ts, event_id) as src, event_type as dst from events) where src is not null group by src, dst"""


def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Event type to the same user's next event type, with how often."""
    e = table(spark, sf, "events").select(F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("src"), F.col("event_type").alias("dst"))
    return e.where("src is not null").groupBy("src", "dst").agg(F.count("*").alias("label"))


SQL["doc_lines"] = "select doc_id, i as seq, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where line <> ''"


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return d.where("line <> ''").select("doc_id", (F.col("i") + 1).cast("long").alias("seq"), "line")


SQL["order_spans"] = """select o_custkey as grp, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as start, date_diff('day', date '1970-01-01', cast(max(l_shipdate) as date)) + 1 as "end", o_orderkey as seq, o_orderpriority as value
  from orders join lineitem on l_orderkey = o_orderkey group by all having start < "end" """


def order_spans(spark: SparkSession, sf: str) -> DataFrame:
    """For each order the days from its date to its last shipment, by customer."""
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    o = table(spark, sf, "orders").join(last, F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    return o.select(F.col("o_custkey").alias("grp"), day("o_orderdate").alias("start"), (day("last") + 1).alias("end"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("value")).where("start < end")


SQL["urgent"] = """select grp, start, "end", seq, value from order_spans where value = '1-URGENT'"""
SQL["calm"] = """select grp, start, "end", seq, value from order_spans where value = '5-LOW'"""


def urgent(spark, sf):
    return order_spans(spark, sf).where("value = '1-URGENT'")


def calm(spark, sf):
    return order_spans(spark, sf).where("value = '5-LOW'")


SQL["path_values"] = """select [r_name, n_name, c_name] as path, cast(round(c_acctbal * 100) as bigint) as value from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""


def path_values(spark: SparkSession, sf: str) -> DataFrame:
    """Region, nation and customer to the account's cents."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.array("r_name", "n_name", "c_name").alias("path"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))


SQL["type_paths"] = """select path, cast(sum(p_size) as bigint) as value from (select [p_brand] || string_split(p_name, ' ') || [p_type] as path, p_size from part) group by path"""


def type_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Brand, the words of the name, and type to the sum of sizes."""
    p = table(spark, sf, "part").select(F.concat(F.array("p_brand"), F.split("p_name", " "), F.array("p_type")).alias("path"), "p_size")
    return p.groupBy("path").agg(F.sum("p_size").cast("long").alias("value"))


SQL["switches"] = """select cast(user_id as varchar) as stream, ts, event_id, case when event_type <> 'error' then event_type || '.' || (cast(json_extract_string(props, '$.k') as bigint) // 10) end as account from events"""


def switches(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events open an account, type and tens of k; an error stops billing."""
    k = F.expr("cast(get_json_object(props, '$.k') as bigint) div 10")
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(F.col("event_type") != "error", F.concat("event_type", F.lit("."), k.cast("string"))).alias("account"))


SQL["bills"] = """select account, cast(sum(ms) as bigint) as ms from (
  select account, epoch_us(lead(ts) over (partition by stream order by ts, account nulls first)) // 1000 - epoch_us(ts) // 1000 as ms from switches) where account is not null and ms is not null group by account"""

SQL["ticks"] = """select event_type as name, 'sum' as kind, cast(round(value * 100) as bigint) as n, user_id, event_id from events union all select event_type, 'max', cast(round(value * 100) as bigint), user_id, event_id from events"""


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.explode(F.array(F.lit("sum"), F.lit("max"))).alias("kind"), F.round(F.col("value") * 100).cast("long").alias("n"), "user_id", "event_id")
    return e


SQL["modules"] = "select p_partkey as module, p_size * 1000 + length(p_name) as src_hash from part"
SQL["stored"] = "select p_partkey as module, p_size * 1000 + length(p_name) + case when p_size = 50 then 1 else 0 end as stored_hash from part where p_brand <> 'Brand#3'"
SQL["imports"] = "select e.src as module, e.dst as imported, m.src_hash + case when e.label = 49 then 1 else 0 end as imported_hash from dag_edges e join modules m on e.dst = m.module"


def modules(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("module"), (F.col("p_size") * 1000 + F.length("p_name")).cast("long").alias("src_hash"))


def stored(spark, sf):
    h = F.col("p_size") * 1000 + F.length("p_name") + F.when(F.col("p_size") == 50, 1).otherwise(0)
    return table(spark, sf, "part").where("p_brand <> 'Brand#3'").select(F.col("p_partkey").alias("module"), h.cast("long").alias("stored_hash"))


def imports(spark, sf):
    m = modules(spark, sf).withColumnRenamed("module", "imported")
    return dag_edges(spark, sf).withColumnRenamed("dst", "imported").join(m, "imported").select(F.col("src").alias("module"), "imported", (F.col("src_hash") + F.when(F.col("label") == 49, 1).otherwise(0)).alias("imported_hash"))


SQL["coo"] = SQL["coo_all"] = "select vec_id + 1 as i, j, cast(round(x * 100) as bigint) as v from (select vec_id, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) as j from embeddings) where round(x * 100) <> 0"


def coo(spark: SparkSession, sf: str) -> DataFrame:
    """All components of the embeddings, in hundredths."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    e = e.select((F.col("vec_id") + 1).alias("i"), (F.col("p") + 1).cast("long").alias("j"), F.round(F.col("x").cast("double") * 100).cast("long").alias("v"))
    return e.where("v <> 0")


coo_all = coo


SQL["issues"] = """select o_orderkey as number, o_orderpriority || ' order of ' || o_custkey || '  ' as title, year(o_orderdate) as milestone,
  list_filter([o_orderpriority, case when o_totalprice > 300000 then 'large' end], lambda x: x is not null) as labels, o_custkey % 2 = 0 as is_pr, o_orderstatus <> 'P' as merged, case when o_orderstatus = 'O' then 'not_planned' else 'completed' end as state_reason from orders"""


def issues(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as issues of a repository."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("number"), F.concat("o_orderpriority", F.lit(" order of "), F.col("o_custkey").cast("string"), F.lit("  ")).alias("title"), F.year("o_orderdate").cast("long").alias("milestone"),
        F.array_compact(F.array("o_orderpriority", F.when(F.col("o_totalprice") > 300000, "large"))).alias("labels"), (F.col("o_custkey") % 2 == 0).alias("is_pr"), (F.col("o_orderstatus") != "P").alias("merged"), F.when(F.col("o_orderstatus") == "O", "not_planned").otherwise("completed").alias("state_reason"),
    )


SQL["words"] = """select doc_id as grp, word, k, cast(sum(length(word) + 1) over (partition by doc_id order by k) - length(word) as bigint) as start from (
  select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) as k from documents)"""
SQL["doc_spans"] = """select grp, start, start + length(word) as "end", case when regexp_matches(word, '[0-9]') then 'number' when word = upper(word) and word <> lower(word) then 'upper' else 'stop' end as tag, k from words
  where length(word) > 0 and (regexp_matches(word, '[0-9]') or (word = upper(word) and word <> lower(word)) or suffix(word, '.'))"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Blank-separated words of documents and their positions from 1."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("grp"), F.posexplode(F.split("text", " ", -1)).alias("p", "word"))
    upto = F.sum(F.length("word") + 1).over(W.partitionBy("grp").orderBy("p").rowsBetween(W.unboundedPreceding, 0))
    return d.select("grp", "word", (F.col("p") + 1).cast("long").alias("k"), (upto - F.length("word")).cast("long").alias("start"))


def doc_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Words with digits, in upper case, or at a sentence's end."""
    w = words(spark, sf)
    upper = (F.col("word") == F.upper("word")) & (F.col("word") != F.lower("word"))
    tag = F.when(F.rlike("word", F.lit("[0-9]")), "number").when(upper, "upper").when(F.endswith("word", F.lit(".")), "stop")
    return w.where("length(word) > 0").select("grp", "start", (F.col("start") + F.length("word")).alias("end"), tag.alias("tag"), "k").where("tag is not null")


SQL["libraries"] = "select distinct lower(replace(p_brand, '#', '')) || '-' || p_size || '.' || (p_size // 7) as name, lower(replace(p_brand, '#', '')) as base from part"


def libraries(spark: SparkSession, sf: str) -> DataFrame:
    """Versioned names from brand and size."""
    base = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    return table(spark, sf, "part").select(F.concat(base, F.lit("-"), F.col("p_size").cast("string"), F.lit("."), F.expr("p_size div 7").cast("string")).alias("name"), base.alias("base")).distinct()
