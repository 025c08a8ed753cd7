"""Queries of text jobs, scalar functions, text sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import text as t
from ..sources import files
from ..sources.tables import materialize, scratch, shared_dir, ship, table
from ..streaming import jobs
from . import views as v
from .base import query
from .repo_queries import WORDS, bench_words

# -- literate text: every third line of a document becomes a code block ---------------------------

LIT = """, s as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)"""


def _literate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    wrap = F.transform("l", lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("```\n"), x, F.lit("\n```\n"))).otherwise(F.concat(x, F.lit("\n"))))
    return d.select("doc_id", F.lit("md").alias("format"), F.array_join(wrap, "").alias("text"))


@query(LIT + """ select doc_id, case when k % 3 = 0 then 'Code' else 'Comment' end as role, md5(string_agg(line || chr(10), '' order by k)) as digest from s group by doc_id, k % 3 = 0
union all select doc_id, 'Markup', md5(repeat('```' || chr(10), cast(2 * count(*) as integer))) from s where k % 3 = 0 group by doc_id""")
def t1_literate_layers(spark, sf):
    parts = t.layers(_literate(spark, sf)).groupBy("doc_id", "role").agg(F.sort_array(F.collect_list(F.struct("idx", "content"))).alias("a"))
    return parts.select("doc_id", "role", F.md5(F.array_join(F.transform("a", lambda x: x["content"]), "")).alias("digest"))


@query(LIT + """ select doc_id, md5(string_agg(case when k % 3 = 0 then '   ' || chr(10) || line || chr(10) || '   ' || chr(10) else regexp_replace(replace(line, chr(9), ' '), '\\S', ' ', 'g') || chr(10) end, '' order by k)) as digest from s group by doc_id""")
def t2_blank_non_code(spark, sf):
    return t.blank_non_code(t.layers(_literate(spark, sf))).select("doc_id", F.md5("text").alias("digest"))


@query(""", o as (select w.grp as doc_id, w.start as pos, substring(d.text, 1, cast(w.start - 1 as integer)) as p from doc_spans w join documents d on d.doc_id = w.grp)
select doc_id, pos, length(p) - length(replace(p, chr(10), '')) + 1 as line, case when contains(p, chr(10)) then strpos(reverse(p), chr(10)) else length(p) + 1 end as col from o""", "words doc_spans")
def t3_line_and_column(spark, sf):
    offsets = v.doc_spans(spark, sf).select(F.col("grp").alias("doc_id"), F.col("start").alias("pos"))
    return t.line_and_column(table(spark, sf, "documents").select("doc_id", "text"), offsets)


#: Every third line becomes code, in the manner of the document's format; in Markdown the lines after these are in a fence of another language.
FORMS = {
    "md": ("```code\n", "{}\n", "```\n", "", ""), "tex": ("\\begin{code}", "\n{}\n  ", "\\end{code}", "text ", " tail\n"), "tree": ("\\code{", "\n{}\n ", "}", "see ", " rest\n"),
    "org": ("#+BEGIN_SRC code :tangle yes\n", "{}\n", "  #+end_src\n", "", ""), "rst": (":\n\n", "  x{}\n", "", "Say:", "back\n"),
}
FORM_NAMES = list(FORMS)


def _sql_text(s: str, line: str = "") -> str:
    """A template as an SQL expression."""
    parts = [("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'") for p in s.split("{}")]
    return f" || {line} || ".join(parts)


def _by_format(parts: tuple[int, ...], line: str = "") -> str:
    return "case doc_id % 5 " + " ".join(f"when {i} then " + " || ".join(_sql_text(FORMS[f][p], line) for p in parts) for i, f in enumerate(FORM_NAMES)) + " end"


def _formats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"), (F.col("doc_id") % 5).alias("f"))

    def wrapped(x, i):
        out = F.when((i % 3 == 0) & (F.col("f") == 0), F.concat(F.lit("```haskell\n"), x, F.lit("\n```\n")))
        for k, (begin, code, end, before, after) in enumerate(FORMS.values()):
            a, b = code.split("{}")
            out = out.when((i % 3 == 2) & (F.col("f") == k), F.concat(F.lit(before + begin + a), x, F.lit(b + end + after)))
        return out.otherwise(F.concat(x, F.lit("\n")))

    name = F.element_at(F.array(*map(F.lit, FORM_NAMES)), (F.col("f") + 1).cast("int"))
    return d.select("doc_id", name.alias("format"), F.array_join(F.transform("l", wrapped), "").alias("text"))


@query(LIT + f""" , x as (select doc_id, k, {_by_format((1,), "line")} as code, {_by_format((0, 2))} as markup, {_by_format((3, 4))} as around, k % 3 = 0 as wrapped,
  case when k % 3 = 1 and doc_id % 5 = 0 then '```haskell' || chr(10) || line || chr(10) || '```' || chr(10) else line || chr(10) end as prose from s)
select doc_id, 'Code' as role, md5(string_agg(code, '' order by k)) as digest from x where wrapped group by doc_id union all select doc_id, 'Markup', md5(string_agg(markup, '' order by k)) from x where wrapped group by doc_id
union all select doc_id, 'Comment', md5(string_agg(case when wrapped then around else prose end, '' order by k)) from x group by doc_id""")
def t1_layers_of_formats(spark, sf):
    parts = t.layers(_formats(spark, sf), only_tagged=True).groupBy("doc_id", "role").agg(F.sort_array(F.collect_list(F.struct("idx", "content"))).alias("a"))
    return parts.select("doc_id", "role", F.md5(F.array_join(F.transform("a", lambda x: x["content"]), "")).alias("digest"))


PAD = "text || case when doc_id % 3 = 0 then '  ' || chr(10) || chr(10) when doc_id % 3 = 1 then chr(10) else ' x' || chr(9) || chr(10) || 'y' end"
NORMAL = "regexp_replace(regexp_replace(text, '[ \\t\\r]+\\n', chr(10), 'g'), '\\s+\\z', '')"


def _padded(spark, sf):
    tail = F.when(F.col("doc_id") % 3 == 0, "  \n\n").when(F.col("doc_id") % 3 == 1, "\n").otherwise(" x\t\ny")
    return table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.concat("text", tail).alias("text"))


@query(f"with d as (select doc_id, source || '/' || doc_id || '.txt' as path, {PAD} as text from documents), n as (select *, {NORMAL} as t from d) select path, md5(case when t = '' then t else t || chr(10) end) as digest, not regexp_matches(path, '^src1/') and text <> case when t = '' then t else t || chr(10) end as violates from n")
def t4_white_space(spark, sf):
    d = _padded(spark, sf)
    bad = t.space_violations(d, [("^src1/", False), ("", True)]).withColumn("violates", F.lit(True))
    return d.select("path", F.md5(t.normalise_space(F.col("text"))).alias("digest")).join(bad, "path", "left").withColumn("violates", F.coalesce("violates", F.lit(False)))


CONFIG = """'-- lib' || chr(10) || 'name: ' || p_name || chr(10) || 'include:' || chr(10) || '  ' || p_brand || ' -- dir' || chr(10) || '    ' || p_type || chr(10) || case when p_size % 4 = 0 then 'broken' || chr(10) when p_size % 4 = 1 then 'include: again' || chr(10) when p_size % 4 = 2 then 'colour: red' || chr(10) else '' end || case when p_size % 5 = 0 then '' else 'depend: base' || chr(10) end"""
ENTRIES = f""", f as (select p_partkey as file, {CONFIG} as text from part), l as (select file, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line from f),
s as (select file, line, rtrim(regexp_replace(raw, '(^|\\s)--(\\s.*)?$', '')) as s from l), h as (select *, regexp_matches(s, '^\\s') as ind, case when not regexp_matches(s, '^\\s') then nullif(regexp_extract(s, '^([^:\\s]+)\\s*:', 1), '') end as head from s where s <> ''),
w as (select *, last_value(head ignore nulls) over (partition by file order by line rows unbounded preceding) as field from h),
e as (select file, line, case when not ind and head is null then 'no colon' when ind and field is null then 'content without field' end as error, field, case when ind then trim(s) else trim(regexp_replace(s, '^[^:\\s]+\\s*:', '')) end as content, head is not null as is_head from w)"""


def _config(spark, sf):
    size = F.col("p_size")
    odd = F.when(size % 4 == 0, "broken\n").when(size % 4 == 1, "include: again\n").when(size % 4 == 2, "colour: red\n").otherwise("")
    text = F.concat(F.lit("-- lib\nname: "), "p_name", F.lit("\ninclude:\n  "), "p_brand", F.lit(" -- dir\n    "), "p_type", F.lit("\n"), odd, F.when(size % 5 == 0, "").otherwise("depend: base\n"))
    return t.config_entries(table(spark, sf, "part").select(F.col("p_partkey").alias("file"), text.alias("text")))


@query("with " + ENTRIES[2:] + " select file, line, case when error is null then field end as field, content, error, is_head from e")
def t5_config_entries(spark, sf):
    return _config(spark, sf)


@query("with " + ENTRIES[2:] + """, h2 as (select file, field, count(*) as n from e where is_head and error is null group by file, field)
select file, field, 'duplicate' as problem from h2 where n > 1 union all select file, field, 'unknown' from h2 where field not in ('name', 'include', 'depend') union all
select f.file, q.field, 'missing' from (select distinct file from e) f, (select unnest(['name', 'depend']) as field) q where not exists (select 1 from h2 where h2.file = f.file and h2.field = q.field)""")
def t5_config_problems(spark, sf):
    return t.config_problems(materialize(_config(spark, sf)), ["name", "depend"], ["name", "include", "depend"])


@query("""with n as (select c_name as name from customer union all select r_name from region union all select r_name || '''''' from region union all select r_name || '₁₂' from region)
select name, case when regexp_matches(name, '''+$') then 'prime' when regexp_matches(name, '[0-9]+$') then 'index' when regexp_matches(name, '[₀₁₂₃₄₅₆₇₈₉]+$') then 'subscript' end as kind,
case when regexp_matches(name, '''+$') then 2 when regexp_matches(name, '[0-9]+$') then cast(regexp_extract(name, '([0-9]+)$', 1) as bigint) when regexp_matches(name, '[₀₁₂₃₄₅₆₇₈₉]+$') then 12 end as n,
regexp_replace(name, '(''+|[0-9]+|[₀₁₂₃₄₅₆₇₈₉]+)$', '') as base,
case when regexp_matches(name, '''+$') then name || '''' when regexp_matches(name, '[0-9]+$') then regexp_replace(name, '[0-9]+$', '') || (cast(regexp_extract(name, '([0-9]+)$', 1) as bigint) + 1) when regexp_matches(name, '[₀₁₂₃₄₅₆₇₈₉]+$') then regexp_replace(name, '[₀₁₂₃₄₅₆₇₈₉]+$', '') || '₁₃' else name || '₁' end as next from n""")
def t7_name_suffixes(spark, sf):
    c, r = table(spark, sf, "customer").select(F.col("c_name").alias("name")), table(spark, sf, "region")
    n = c.union(r.select("r_name")).union(r.select(F.concat("r_name", F.lit("''")))).union(r.select(F.concat("r_name", F.lit("₁₂"))))
    s = t.suffix_view(F.col("name"))
    return n.select("name", s["kind"].alias("kind"), s["n"].alias("n"), s["base"].alias("base"), t.next_name(F.col("name")).alias("next"))


#: Every name with every name, itself too.
NAMES = "(select x.p_name as a, y.p_name as b from (select distinct p_name from part) x, (select distinct p_name from part) y)"
#: So many names are paired with all in one task.
DEALT = 256


def _names(spark, sf):
    """Pairs of all different names, null as one of them; their number is the square of the number of names."""
    names = materialize(table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct())  # its true size decides how it is joined
    return names.repartition(1 + names.count() // DEALT).crossJoin(names.withColumnRenamed("a", "b"))


@query(f"""select a, b, a[1:coalesce(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i])), 0)] as prefix,
reverse(reverse(a)[1:coalesce(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: reverse(a)[1:i] = reverse(b)[1:i])), 0)]) as suffix, case when suffix(a, b[-4:]) then a[1:length(a) - 4] end as stripped, case when prefix(a, 'red') then a[4:] end as rest from {NAMES}""")
def t8_common_parts(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _names(spark, sf).select("a", "b", t.common_prefix(a, b).alias("prefix"), t.common_suffix(a, b).alias("suffix"), t.strip_suffix(a, F.right(b, F.lit(4))).alias("stripped"), t.strip_prefix(a, F.lit("red")).alias("rest"))


@query(f"select a, b, list_min(list_filter(range(0, length(a) + 1), lambda i: starts_with(b, a[i + 1:]))) as start, length(a) - list_min(list_filter(range(0, length(a) + 1), lambda i: starts_with(b, a[i + 1:]))) as length from {NAMES}")
def t9_find_overlap(spark, sf):
    return _names(spark, sf).withColumn("o", t.find_overlap(F.col("a"), F.col("b"))).select("a", "b", F.col("o.start").cast("long").alias("start"), F.col("o.length").cast("long").alias("length"))


@query("""select o_orderkey, '"' || replace(replace(replace(o_orderpriority || '"\\' || chr(10), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"' as quoted, '  a' || chr(10) || chr(10) || '  ' || o_orderstatus as indented, format('{:,}', cast(o_totalprice * 100 as bigint)) as thousands,
o_orderpriority as trimmed, array_to_string(list_filter(string_split_regex(o_orderpriority || ', ' || o_orderstatus || ',', '[,\\s]+'), lambda x: x <> ''), '|') as parts, cast(o_custkey as varchar) as no_dot from orders""")
def t10_formatting(spark, sf):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey", t.quote(F.concat(p, F.lit('"\\\n'))).alias("quoted"), t.indent(F.concat(F.lit("a\n\n"), s), 2).alias("indented"), t.thousands(F.round(F.col("o_totalprice") * 100).cast("long")).alias("thousands"),
        F.trim(F.concat(F.lit("  "), p, F.lit(" "))).alias("trimmed"), F.array_join(t.split_commas(F.concat(p, F.lit(", "), s, F.lit(","))), "|").alias("parts"), t.without_dot_zero(F.col("o_custkey").cast("double")).alias("no_dot"),
    )


@query()
def t11_content_hashes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.xxhash64("text").alias("hash"))
    return t.combined_hashes(d, "source", "doc_id")


@query("select l_orderkey, l_partkey, l_linenumber, l_partkey + l_suppkey as plus, l_partkey * l_suppkey as times, greatest(l_suppkey - l_partkey, 0) as minus, l_partkey // l_linenumber as div, l_partkey % l_linenumber as mod, l_partkey = l_suppkey as eq, l_partkey < l_suppkey as lt from lineitem")
def t12_naturals(spark, sf):
    a, b, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (a + b).alias("plus"), (a * b).alias("times"), t.nat_minus(b, a).alias("minus"), F.expr("l_partkey div l_linenumber").alias("div"), (a % n).alias("mod"), (a == b).alias("eq"), (a < b).alias("lt"))


SPECIAL = "(select event_id, case event_type when 'error' then cast('nan' as double) when 'signup' then cast('inf' as double) when 'click' then cast('-inf' as double) when 'view' then cast('-0.0' as double) else round(value) / 2 end as a, value as b from events)"


def _floats(spark, sf):
    e = F.col("event_type")
    a = F.when(e == "error", float("nan")).when(e == "signup", float("inf")).when(e == "click", float("-inf")).when(e == "view", F.lit(-0.0)).otherwise(F.round("value") / 2)
    return table(spark, sf, "events").select("event_id", a.alias("a"), F.col("value").alias("b"))


@query(f"select event_id, not isnan(a) and a = a as eq_self, not isnan(a) and a <= b as le, not isnan(a) and a < b as lt, isinf(a) as infinite, isnan(a) as nan, a = 0 and cast(a as varchar)[1] = '-' as negative_zero, not isnan(a) and not isinf(a) and a = floor(a) as safe from {SPECIAL}")
def t13_float_classes(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _floats(spark, sf).select("event_id", t.float_eq(a, a).alias("eq_self"), t.float_le(a, b).alias("le"), t.float_lt(a, b).alias("lt"), t.is_infinite(a).alias("infinite"), F.isnan(a).alias("nan"), t.is_negative_zero(a).alias("negative_zero"), t.is_safe_integer(a).alias("safe"))


@query(f"select event_id, case when isfinite(a) then cast(round_even(a, 0) as bigint) end as rounded, case when isfinite(a) then cast(floor(a) as bigint) end as low, case when isfinite(a) then cast(ceil(a) as bigint) end as high from {SPECIAL}")
def t14_float_to_integer(spark, sf):
    a = F.col("a")
    return _floats(spark, sf).select("event_id", t.to_integer(a, "round").alias("rounded"), t.to_integer(a, "floor").alias("low"), t.to_integer(a, "ceiling").alias("high"))


@query()
def t15_float_parts(spark, sf):
    d = _floats(spark, sf).select("event_id", "a", t.float_parts(F.col("a")).alias("p")).select("event_id", "a", "p.*")
    return d.withColumn("encoded", t.encode_float(F.col("mantissa"), F.col("exponent")))


FUNCTIONS = {"sqrt": "sqrt(x)", "exp": "exp(x)", "log": "ln(x)", "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "asin": "asin(y)", "acos": "acos(y)", "atan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)", "asinh": "asinh(x)", "acosh": "acosh(1 + x)", "atanh": "atanh(y)"}


@query("select event_id, " + ", ".join(f"round({e}, 6) as f_{n}" for n, e in FUNCTIONS.items()) + ", round(pow(x, y), 6) as f_pow, round(x + y - x * y / x, 6) as arithmetic from (select event_id, 0.1 + value / 100 as x, 1 / (2 + value) as y from events)")
def t16_float_math(spark, sf):
    d = table(spark, sf, "events").select("event_id", (0.1 + F.col("value") / 100).alias("x"), (1 / (2 + F.col("value"))).alias("y"))
    arg = {"asin": F.col("y"), "acos": F.col("y"), "atanh": F.col("y"), "acosh": 1 + F.col("x")}
    return d.select("event_id", *[F.round(f(arg.get(n, F.col("x"))), 6).alias(f"f_{n}") for n, f in t.FLOAT_MATH.items()], F.round(F.pow("x", "y"), 6).alias("f_pow"), F.round(F.col("x") + F.col("y") - F.col("x") * F.col("y") / F.col("x"), 6).alias("arithmetic"))


@query("""select doc_id, length(regexp_replace(text, '[^\\p{Ll}]', '', 'g')) as n_lower, length(regexp_replace(text, '[^0-9]', '', 'g')) as n_digit, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) as n_alpha, length(regexp_replace(text, '[^\\s]', '', 'g')) as n_space,
length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) as n_ascii, length(regexp_replace(text, '[^\\x00-\\x{FF}]', '', 'g')) as n_latin1, length(regexp_replace(text, '[\\p{C}\\x{2028}\\x{2029}]', '', 'g')) as n_print, length(regexp_replace(text, '[^0-9A-Fa-f]', '', 'g')) as n_hex, upper(text[1]) as up, lower(text[1]) as down, unicode(text[1]) as code from documents""")
def t17_character_classes(spark, sf):
    c = t.class_counts(F.col("text"))
    first = F.substr("text", F.lit(1), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", *[c[n].alias(f"n_{n}") for n in ("lower", "digit", "alpha", "space", "ascii", "latin1", "print", "hex")], F.upper(first).alias("up"), F.lower(first).alias("down"), F.ascii(first).cast("long").alias("code"))


@query("select c_custkey, length(c_name) as n, array_to_string(string_split(c_name, ''), ',') as letters, c_name || '!' as appended, c_name = c_mktsegment as same, c_name[1] as head, c_name[2:] as tail from customer")
def t18_strings(spark, sf):
    u = t.uncons(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", F.length("c_name").cast("long").alias("n"), F.array_join(F.filter(F.split("c_name", ""), lambda x: x != ""), ",").alias("letters"), F.concat("c_name", F.lit("!")).alias("appended"), (F.col("c_name") == F.col("c_mktsegment")).alias("same"), u["head"].alias("head"), u["tail"].alias("tail"))


@query(f"""select distinct w as name from (select regexp_replace(word, '[^A-Za-z]', '', 'g') as w from ({WORDS})) where w <> '' and w not in (select distinct regexp_replace(word, '[^A-Za-z]', '', 'g') from ({WORDS}) where length(word) < 5)
and w not in (select unnest(regexp_extract_all(text, '([A-Za-z]{{4,}})', 1)) from documents)""")
def t20_coverage_gaps(spark, sf):
    w = bench_words(spark, sf).select("word", F.regexp_replace("word", "[^A-Za-z]", "").alias("name"))
    return t.coverage_gaps(w.where("name <> ''").select("name"), w.where("length(word) < 5").select("name"), table(spark, sf, "documents").select("text"), "([A-Za-z]{4,})")


@query(f"""with w as (select distinct regexp_replace(word, '[^A-Za-z]', '', 'g') as word from ({WORDS}) where regexp_replace(word, '[^A-Za-z]', '', 'g') <> '') select a.word as name, b.word as candidate from w a, w b where a.word <> b.word and levenshtein(replace(lower(a.word), '_', ''), replace(lower(b.word), '_', '')) <= length(replace(lower(a.word), '_', '')) // 3""")
def j12_suggest(spark, sf):
    w = bench_words(spark, sf).select(F.regexp_replace("word", "[^A-Za-z]", "").alias("word")).where("word <> ''").distinct()
    return t.suggest(w.select(F.col("word").alias("name")), w.select(F.col("word").alias("candidate"))).where("name <> candidate")


@query("""with w as (select unnest(string_split(p_name, ' ')) as word from part union select event_type[2] || event_type[1] || event_type[3:] from events), o as (select event_type as option from events union select unnest(string_split(p_name, ' ')) from part),
d as (select word, option, damerau_levenshtein(word, option) as distance from w, o) select * from d where distance <= 3 qualify distance = min(distance) over (partition by word)""")
def j13_close_options(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).union(table(spark, sf, "events").select(F.concat(F.substr("event_type", F.lit(2), F.lit(1)), F.substr("event_type", F.lit(1), F.lit(1)), F.substr("event_type", F.lit(3)))))
    options = table(spark, sf, "events").select(F.col("event_type").alias("option")).union(table(spark, sf, "part").select(F.explode(F.split("p_name", " "))))
    return t.close_options(words, options, nearest_only=True)


# -- sources and sinks ----------------------------------------------------------------------------


@query("select item_id, length(text) + 1 as chars, md5(text || chr(10)) as digest from benchmark")
def io1_whole_texts(spark, sf):
    path = scratch(spark)
    files.write_whole_texts(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("name"), "text"), path)
    return files.read_named_texts(spark, path).select(F.col("name").cast("long").alias("item_id"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("""select path, case when suffix(path, '.lit.md') then 'md' when suffix(path, '.lit.rst') then 'rst' when suffix(path, '.lit') then 'tex' end as format from (select p_partkey || case p_size % 4 when 0 then '.lit.md' when 1 then '.lit.rst' when 2 then '.lit' else '.src' end as path from part)""")
def io2_format_of(spark, sf):
    s = F.col("p_size") % 4
    p = table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.when(s == 0, ".lit.md").when(s == 1, ".lit.rst").when(s == 2, ".lit").otherwise(".src")).alias("path"))
    return p.withColumn("format", t.format_of(F.col("path")))


@query("""with f as (select p_partkey as file, p_name || ' -- note' || chr(10) || chr(10) || '  ' || p_brand || chr(10) || '-- all comment' || chr(10) || p_type as text from part)
select file, unnest([1, 3, 5]) as line, unnest([p_name, p_brand, p_type]) as entry from f join part on p_partkey = file""")
def io3_list_entries(spark, sf):
    text = F.concat("p_name", F.lit(" -- note\n\n  "), "p_brand", F.lit("\n-- all comment\n"), "p_type")
    return t.list_entries(table(spark, sf, "part").select(F.col("p_partkey").alias("file"), text.alias("text")))


@query("select s_suppkey as log, s_name as \"case\", s_suppkey + 10 as mem_mb, s_nationkey + 0.5 as seconds, 2 * s_suppkey + 7 as metas, 12000 + s_suppkey as constraints from supplier")
def io4_benchmark_logs(spark, sf):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("metas = "), k, F.lit("\nmetas = "), (F.col("s_suppkey") + 7).cast("string"), F.lit("\nconstraints "), F.format_number(F.col("s_suppkey") + 12000, 0), F.lit("\n  "), (F.col("s_suppkey") + 10).cast("string"), F.lit(" MB total memory in use\n  Total   time  "), F.col("s_nationkey").cast("string"), F.lit(".50s"))
    return files.benchmark_rows(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("log"), F.col("s_name").alias("case"), text.alias("text")))


@query("""select grp, start, '{"range":[' || start || ',' || "end" || '],"atoms":["' || tag || '","k' || (k % 3) || '"],"tokenBased":' || case when tag = 'upper' then 'true' else 'false' end || case when k % 2 = 0 then ',"note":"' || tag || '"' else '' end || '}' as json from doc_spans""", "words doc_spans")
def io6_annotation_json(spark, sf):
    s = v.doc_spans(spark, sf)
    rows = s.select("grp", "start", "end", F.col("tag").alias("aspect"), F.array(F.concat(F.lit("k"), (F.col("k") % 3).cast("string"))).alias("others"), F.when(F.col("k") % 2 == 0, F.col("tag")).alias("note"), (F.col("tag") == "upper").alias("flag"), F.lit(None).cast("string").alias("site"))
    return files.annotation_json(rows)


# -- streams --------------------------------------------------------------------------------------


def _stream(spark, sf, name):
    ship(spark)
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # one file or a folder of them


@query("select kind, name, case when kind = 'max' then max(n) else cast(sum(n) as bigint) end as value from ticks group by kind, name", "ticks")
def st1_running_counters(spark, sf):
    e = _stream(spark, sf, "events").select(F.col("event_type").alias("name"), F.explode(F.array(F.lit("sum"), F.lit("max"))).alias("kind"), F.round(F.col("value") * 100).cast("long").alias("n"))
    at = f"{shared_dir(spark)}/counters-{uuid.uuid4().hex}"
    q = jobs.running_counters(e).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out"))
    q.start().awaitTermination()
    return spark.read.schema("kind string, name string, value long").parquet(f"{at}/out")


@query("""select stream, account, cast(sum(ms) as bigint) as ms from (select stream, account, epoch_us(lead(ts) over (partition by stream order by ts, account nulls first)) // 1000 - epoch_us(ts) // 1000 as ms from switches)
where account is not null and ms is not null group by stream, account""", "switches")
def st2_running_bills(spark, sf):
    e = _stream(spark, sf, "events")
    k = F.expr("cast(get_json_object(props, '$.k') as bigint) div 10").cast("string")
    s = e.select(F.col("user_id").cast("string").alias("stream"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.when(F.col("event_type") != "error", F.concat("event_type", F.lit("."), k)).alias("account"), F.lit(False).alias("reset"))
    at = f"{shared_dir(spark)}/bills-{uuid.uuid4().hex}"
    jobs.running_bills(s).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(jobs.BILLS).parquet(f"{at}/out").where("account is not null").groupBy("stream", "account").agg(F.sum("ms").alias("ms"))
