"""Text jobs and scalar functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# -- literate text --------------------------------------------------------------------------------

#: What follows the base ending in a file name, and the format it stands for.
ENDINGS = {".rst": "rst", ".tex": "tex", ".md": "md", ".org": "org", ".tree": "tree", ".typ": "md", "": "tex"}
#: Marks of the formats; {} is the language's name.
FENCE, TEX, TREE, ORG, BLOCK = "```", ("\\begin{code}", "\\end{code}"), ("\\{}{{", "}"), ("#+begin_src {} ", "#+end_src"), "::"
KNOWN = ("tex", "tree", "org", "md", "rst")
LANGUAGE = "code"


def format_of(path: Column, base: str = ".lit") -> Column:
    """The text format of a file name, null if it has none of the known endings behind the base ending."""
    return F.coalesce(*[F.when(F.endswith(path, F.lit(base + more)), F.lit(name)) for more, name in ENDINGS.items()])


class _Lines:
    """A text by lines; lines end at newlines only."""

    def __init__(self, text: str):
        self.text, self.starts = text, [0, *(m.end() for m in re.finditer("\n", text))]
        if self.starts[-1] == len(text):
            self.starts.pop()

    def __len__(self) -> int:
        return len(self.starts)

    def at(self, i: int) -> int:
        """Where line i starts; the text's end behind the last."""
        return self.starts[i] if i < len(self.starts) else len(self.text)

    def __getitem__(self, i: int) -> str:
        return self.text[self.at(i) : self.at(i + 1)]

    def first(self, i: int, holds: Callable[[str], bool]) -> int:
        """The first line from i on that holds, or the number of lines."""
        return next((j for j in range(i, len(self)) if holds(self[j])), len(self))


# A format looks for its next block from line i on and gives four positions, where the opening mark, the code, the closing mark and the
# text behind it start, and the line to look on from; None if there is no more block.


def _mark_in(line: str, mark: str) -> int | None:
    """The last place of a mark that is neither behind a percent sign nor escaped by a backslash."""
    i, found = 0, None
    while i < len(line) and line[i] != "%":
        found = i if line.startswith(mark, i) else found
        i += 2 if line[i] == "\\" else 1
    return found


def _next_marked(lines: _Lines, i: int, begin: str, end: str) -> tuple | None:
    """TeX-like: from a mark within a line to a line that starts with the other; what follows on their lines isn't code."""
    i = lines.first(i, lambda x: _mark_in(x, begin) is not None)
    if i == len(lines):
        return None
    line = lines[i]
    j = lines.first(i + 1, lambda x: x.lstrip(" \t").startswith(end))
    blanks = len(lines[j]) - len(lines[j].lstrip(" \t")) if j < len(lines) else 0
    stop = lines.at(j) + blanks
    return lines.at(i) + _mark_in(line, begin), lines.at(i) + len(line.rstrip("\n")), stop, stop + len(end) * (j < len(lines)), j + 1


def _next_section(lines: _Lines, i: int, begin: str, end: str) -> tuple | None:
    """Org: whole lines are marks, in any case of letters."""
    i = lines.first(i, lambda x: begin in re.sub(r"\s", " ", x.lower()))
    j = lines.first(i + 1, lambda x: x.lstrip().lower().startswith(end))
    return (lines.at(i), lines.at(i + 1), lines.at(j), lines.at(j + 1), j + 1) if i < len(lines) else None


def _next_fence(lines: _Lines, i: int, language: str, only_tagged: bool) -> tuple | None:
    """Markdown: a fence at a line's end, bare or with the language's name (only_tagged: the latter alone), to a line that is a bare fence; fences of
    other languages are passed over with what they hold."""
    while i < len(lines):
        body = lines[i].rstrip()
        tag = next((t for t in (language, "") if body.endswith(FENCE + t)), None)
        other = body.lstrip().startswith(FENCE) and re.fullmatch("[a-zA-Z0-9-]*", body.lstrip()[len(FENCE) :])
        if tag is not None or other:
            j = lines.first(i + 1, lambda x: x.strip() == FENCE)
            if tag or tag == "" and not only_tagged:
                return lines.at(i) + len(body) - len(FENCE + tag), lines.at(i + 1), lines.at(j), lines.at(j + 1), j + 1
            i = j
        i += 1
    return None


def _next_indented(lines: _Lines, i: int) -> tuple | None:
    """reStructuredText: the indented lines behind one that ends in two colons, which is no comment. Of the colons one belongs to the
    text before them, if that goes on to them; blank lines before the code belong to the mark."""
    comment = lambda x: x.lstrip().startswith("..") and (x.lstrip() + " ")[2].isspace()
    i = lines.first(i, lambda x: x.rstrip().endswith(BLOCK) and not comment(x))
    if i == len(lines):
        return None
    before = lines[i].rstrip()[: -len(BLOCK)]
    opens = lines.at(i) + (len(before) + 1 if before and not before[-1].isspace() else 0)
    j = lines.first(i + 1, lambda x: bool(x.strip()))
    margin = lines[j][: len(lines[j]) - len(lines[j].lstrip())]
    k = lines.first(j, lambda x: bool(x.strip()) and not x.startswith(margin)) if margin else j
    return opens, lines.at(j), lines.at(k), lines.at(k), k


def literate_layers(text: str, format: str, only_tagged: bool = False, language: str = LANGUAGE) -> list[tuple[str, int, int]]:
    """(role, start, end) of the layers of a text, positions from 0; together they are the text. Role: Code, Markup (what opens or closes
    code) or Comment; none is empty."""
    lines = _Lines(text)
    find = {
        "md": lambda i: _next_fence(lines, i, language, only_tagged), "rst": lambda i: _next_indented(lines, i), "tex": lambda i: _next_marked(lines, i, *TEX),
        "tree": lambda i: _next_marked(lines, i, *(m.format(language) if "{}" in m else m for m in TREE)), "org": lambda i: _next_section(lines, i, *(m.format(language) for m in ORG)),
    }[format]
    out: list[tuple[str, int, int]] = []
    at = line = 0
    while block := find(line):
        *cuts, line = block
        for role, end in zip(("Comment", "Markup", "Code", "Markup"), cuts):
            if at < end:
                out.append((role, at, end))
                at = end
    return [*out, ("Comment", at, len(text))] if at < len(text) else out


def layers(docs: DataFrame, only_tagged: bool = False, language: str = LANGUAGE) -> DataFrame:
    """(doc_id, idx, role, start, end, content) of docs(doc_id, format, text); positions from 1. only_tagged: Markdown blocks count as code only if they name
    the language. Null and empty texts have no layers, and neither have texts of a format that is null or not one of KNOWN."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, f, t in zip(pdf["doc_id"], pdf["format"], pdf["text"]):
                for i, (role, a, b) in enumerate(literate_layers(t or "", f, only_tagged, language)):
                    rows.append((d, i, role, a + 1, b + 1, t[a:b]))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "role", "start", "end", "content"])

    return docs.select("doc_id", "format", "text").where(F.col("format").isin(*KNOWN)).mapInPandas(run, "doc_id long, idx long, role string, start long, end long, content string")


def blank_non_code(parts: DataFrame) -> DataFrame:
    """(doc_id, text): layers put together again, with spaces for the characters of all but code, so that positions stay; other white space stays, tabs become
    spaces."""
    c = F.when(F.col("role") == "Code", F.col("content")).otherwise(F.regexp_replace(F.replace(F.col("content"), F.lit("\t"), F.lit(" ")), r"\S", " "))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", c.alias("c")))), lambda x: x["c"]), "").alias("text"))


# -- positions, lint, config ----------------------------------------------------------------------


def line_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start, end): lines from 1 and their character positions from 1, the newline included in end."""
    parts = F.split("text", "\n", -1)
    rows = docs.select("doc_id", F.posexplode(parts).alias("_i", "_l")).withColumn("_n", F.length("_l") + 1)
    upto = F.sum("_n").over(W.partitionBy("doc_id").orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("doc_id", (F.col("_i") + 1).alias("line"), (upto - F.col("_n") + 1).alias("start"), (upto + 1).alias("end"))


def line_and_column(docs: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets(doc_id, pos) with line and col, all from 1; positions outside their text are left out. A merge: every offset takes the last
    line start before it."""
    rest = F.struct(*[F.col(c) for c in offsets.columns])
    s = line_starts(docs)
    starts = s.select("doc_id", F.col("start").alias("_at"), "line", "end", F.lit(None).cast(offsets.select(rest.alias("r")).schema["r"].dataType).alias("_r"))
    both = starts.unionByName(offsets.select("doc_id", F.col("pos").alias("_at"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("long").alias("end"), rest.alias("_r")))
    before = W.partitionBy("doc_id").orderBy("_at", F.col("_r").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_r").isNull(), F.struct(F.col("_at").alias("start"), "line", "end")), ignorenulls=True).over(before)
    found = both.withColumn("_l", last).where("_r is not null and _l is not null and _at < _l.end")
    return found.select("_r.*", "_l.line", (F.col("_at") - F.col("_l.start") + 1).alias("col"))


def normalise_space(text: Column) -> Column:
    """No trailing blanks, no blank lines at the end, one newline at the end; an empty text stays empty."""
    t = F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+\n", "\n"), r"\s+\z", "")
    return F.when(t == "", t).otherwise(F.concat(t, F.lit("\n")))


def space_violations(files: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    """(path): of files(path, text) that the first matching rule (pattern, included) includes, those whose white space is not normal."""
    take = F.lit(False)
    for pattern, included in reversed(rules):
        take = F.when(F.rlike("path", F.lit(pattern)), included).otherwise(take)
    return files.where(take & (F.col("text") != normalise_space(F.col("text")))).select("path")


def config_entries(files: DataFrame) -> DataFrame:
    """(file, line, field, content, error) of key/value files(file, text): "field: content" lines, indented content lines under the field before them, "--" comments
    and blank lines dropped. error: "no colon", "content without field" or null."""
    l = files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("_i", "raw"))
    l = l.select("file", (F.col("_i") + 1).alias("line"), F.rtrim(F.regexp_replace("raw", r"(^|\s)--(\s.*)?$", "")).alias("s")).where("s <> ''")
    indented = F.rlike("s", F.lit(r"^\s"))
    head = F.when(~indented, F.rtrim(F.regexp_extract("s", r"^([^:\s]+)\s*:", 1)))
    l = l.withColumn("_head", F.when(head != "", head)).withColumn("_ind", indented)
    w = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    l = l.withColumn("field", F.last("_head", ignorenulls=True).over(w))
    error = F.when(~F.col("_ind") & F.col("_head").isNull(), "no colon").when(F.col("_ind") & F.col("field").isNull(), "content without field")
    content = F.when(F.col("_ind"), F.trim("s")).otherwise(F.trim(F.regexp_replace("s", r"^[^:\s]+\s*:", "")))
    return l.select("file", "line", F.when(error.isNull(), F.col("field")).alias("field"), content.alias("content"), error.alias("error"), F.col("_head").isNotNull().alias("is_head"))


def config_problems(entries: DataFrame, required: list[str], known: list[str]) -> DataFrame:
    """(file, field, problem): missing, duplicate and unknown fields."""
    heads = entries.where("is_head and error is null").groupBy("file", "field").agg(F.count("*").alias("n"))
    dup = heads.where("n > 1").select("file", "field", F.lit("duplicate").alias("problem"))
    unknown = heads.where(~F.col("field").isin(*known)).select("file", "field", F.lit("unknown").alias("problem"))
    need = entries.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, required))).alias("field"))
    return dup.union(unknown).union(need.join(heads, ["file", "field"], "left_anti").select("file", "field", F.lit("missing").alias("problem")))


def list_entries(files: DataFrame) -> DataFrame:
    """(file, line, entry): numbered lines of list files(file, text) without "--" comments and blank lines."""
    l = files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("_i", "raw"))
    return l.select("file", (F.col("_i") + 1).alias("line"), F.trim(F.regexp_replace("raw", r"(^|\s)--(\s.*)?$", "")).alias("entry")).where("entry <> ''")


# -- fuzzy joins ----------------------------------------------------------------------------------


def canonical(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit(""))


def suggest(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, candidate): distance of the canonical forms at most a third of the name's length, rounded down.

    Lengths then differ by as much at most, and of its third + 1 pieces of equal length a name shares one with the candidate, near the same place (pigeonhole): pairs
    are joined on such a piece, then verified."""
    n = names.select("name").distinct().withColumn("a", canonical(F.col("name"))).withColumn("k", F.floor(F.length("a") / 3).cast("int"))
    c = candidates.select("candidate").distinct().withColumn("b", canonical(F.col("candidate")))
    # piece i of k + 1: from floor(i * len / (k + 1)); all have one character or more, or the name is empty
    at = lambda i: F.floor(i * F.length("a") / (F.col("k") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.struct(at(i).alias("p"), F.substr("a", at(i) + 1, at(i + 1) - at(i)).alias("g")))
    probes = n.select("name", "a", "k", F.explode(pieces).alias("x")).select("name", "a", "k", "x.p", "x.g", F.length("x.g").alias("m"))
    sizes = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(F.lit(0), F.floor(F.length("b") * 0.7).cast("int")), F.ceil(F.length("b") * 1.5).cast("int") + 1), lambda s: F.array(F.floor(s / (F.floor(s / 3) + 1)).cast("int"), F.ceil(s / (F.floor(s / 3) + 1)).cast("int")))))
    grams = c.select("candidate", "b", F.explode(sizes).alias("m")).where("m >= 1 and m <= length(b)")
    grams = grams.select("candidate", "b", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("b") - F.col("m") + 1), lambda i: F.substr("b", i, F.col("m"))))).alias("g"))
    close = F.expr("levenshtein(a, b, k) >= 0")
    found = probes.where("g <> ''").select("name", "a", "k", "g").distinct().join(grams, "g").where((F.abs(F.length("a") - F.length("b")) <= F.col("k")) & close).select("name", "candidate").distinct()
    return found


def _osa(a: str, b: str, most: int) -> int:
    """Restricted Damerau-Levenshtein distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most and min(one) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


#: Leading characters of a name that are indexed: 93 strings with up to three of eight left out.
INDEXED = 8


def _with_deletions(df: DataFrame, name: str, most: int) -> DataFrame:
    """df with _key: one row for each string that is left of the name's beginning with up to most characters left out."""
    cut = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))).otherwise(F.array().cast("array<string>"))
    out = df.withColumn("_left0", F.array(F.substr(name, F.lit(1), F.lit(max(INDEXED, 2 * most)))))
    for k in range(most):
        out = out.withColumn(f"_left{k + 1}", F.array_distinct(F.flatten(F.transform(f"_left{k}", cut))))
    lefts = [f"_left{k}" for k in range(most + 1)]
    return out.withColumn("_key", F.explode(F.array_distinct(F.concat(*lefts)))).drop(*lefts)


def close_options(words: DataFrame, options: DataFrame, most: int = 3, nearest_only: bool = False) -> DataFrame:
    """(word, option, distance) within a restricted Damerau-Levenshtein distance; nearest_only keeps the least distance of each word. Null words and
    options match nothing.

    An index of deletion neighbourhoods: an edit (insertion, deletion, replacement, swap of neighbours) costs either side one character at most, so
    names within most edits have a string in common that is left when up to most characters go from each, and so have their beginnings.
    Words meet options on such a string; Spark's own distance (a swap is two edits there) drops most, and what is left is verified in Python."""

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_osa(x, y, most) for x, y in zip(a, b)], dtype="int32")

    w = _with_deletions(words.select("word").where("word is not null").distinct(), "word", most)
    pairs = w.join(_with_deletions(options.select("option").where("option is not null").distinct(), "option", most), "_key").where(F.abs(F.length("word") - F.length("option")) <= most)
    near = pairs.select("word", "option").distinct().where(F.expr(f"levenshtein(word, option, {2 * most}) >= 0"))
    out = near.withColumn("distance", distance("word", "option")).where(F.col("distance") <= most).select("word", "option", "distance")
    if nearest_only:
        out = out.withColumn("_m", F.min("distance").over(W.partitionBy("word"))).where("distance = _m").drop("_m")
    return out


# -- strings --------------------------------------------------------------------------------------

#: Subscript digits 0 to 9.
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"


def suffix_view(name: Column) -> Column:
    """struct(base, kind, n): trailing primes, digits or subscript digits of a name; kind null if there are none."""
    digits, subs, primes = F.regexp_extract(name, r"^(.*?)([0-9]+)$", 2), F.regexp_extract(name, rf"^(.*?)([{SUBSCRIPTS}]+)$", 2), F.regexp_extract(name, r"^(.*?)('+)$", 2)
    n = F.when(primes != "", F.length(primes).cast("long")).when(digits != "", digits.cast("long")).when(subs != "", F.translate(subs, SUBSCRIPTS, "0123456789").cast("long"))
    kind = F.when(primes != "", "prime").when(digits != "", "index").when(subs != "", "subscript")
    return F.struct(F.expr("''").alias("_"), kind.alias("kind"), n.alias("n"), F.regexp_replace(name, rf"('+|[0-9]+|[{SUBSCRIPTS}]+)$", "").alias("base")).dropFields("_")


def render_suffix(kind: Column, n: Column) -> Column:
    digits = n.cast("string")
    return F.when(kind == "prime", F.repeat(F.lit("'"), n.cast("int"))).when(kind == "index", digits).when(kind == "subscript", F.translate(digits, "0123456789", SUBSCRIPTS)).otherwise("")


def next_name(name: Column) -> Column:
    """The name with its suffix raised by one; a name without a suffix gets subscript 1."""
    v = suffix_view(name)
    return F.concat(v["base"], render_suffix(F.coalesce(v["kind"], F.lit("subscript")), F.coalesce(v["n"], F.lit(0)) + 1))


def common_prefix(a: Column, b: Column) -> Column:
    """Empty if b is null."""
    n = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))
    return F.substr(a, F.lit(1), F.coalesce(n, F.lit(0)))


def common_suffix(a: Column, b: Column) -> Column:
    return F.reverse(common_prefix(F.reverse(a), F.reverse(b)))


def strip_suffix(text: Column, suffix: Column) -> Column:
    """Without the suffix; null if it isn't there."""
    return F.when(F.endswith(text, suffix), F.substr(text, F.lit(1), F.length(text) - F.length(suffix)))


def strip_prefix(text: Column, prefix: Column) -> Column:
    return F.when(F.startswith(text, prefix), F.substr(text, F.length(prefix) + 1))


def find_overlap(x: Column, y: Column) -> Column:
    """struct(start, length) of the longest suffix of x that y starts with; (length of x, 0) if none."""
    start = F.array_min(F.filter(F.sequence(F.lit(0), F.length(x)), lambda i: F.startswith(y, F.substr(x, i + 1))))
    return F.struct(start.alias("start"), (F.length(x) - start).alias("length"))


def quote(s: Column) -> Column:
    """In double quotes, with backslashes before quotes and backslashes and \\n for newlines."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def indent(s: Column, n: int) -> Column:
    """n spaces before every line that is not empty."""
    return F.regexp_replace(s, r"(?m)^(?=.)", " " * n)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def split_commas(s: Column) -> Column:
    """Parts between commas and blanks, empty ones dropped."""
    return F.filter(F.split(s, r"[,\s]+"), lambda x: x != "")


def without_dot_zero(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def combine_hashes(hashes: Column) -> Column:
    """One 64-bit hash of an array of hashes, in order."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: F.xxhash64(acc, h))


def combined_hashes(rows: DataFrame, key: str, seq: str, fan: int = 1024) -> DataFrame:
    """(key, n, combined): the hashes of rows(key, seq, hash) combined in the order of seq, a whole number not below 0: those whose seq has the same quotient by fan
    to one, then the quotients likewise, until one is left, so that no array has more than fan entries."""
    d = rows.groupBy(key, F.floor(F.col(seq) / fan).cast("long").alias("_q"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("hash").alias("h")))), lambda x: x["h"])
    d = d.agg(F.count("*").alias("n"), combine_hashes(ordered).alias("hash"))
    top = (rows.agg(F.max(seq)).first()[0] or 0) // fan
    while top:
        d = d.groupBy(key, F.floor(F.col("_q") / fan).cast("long").alias("_u")).agg(F.sum("n").alias("n"), combine_hashes(F.transform(F.sort_array(F.collect_list(F.struct(F.col("_q").alias("s"), F.col("hash").alias("h")))), lambda x: x["h"])).alias("hash"))
        d = d.withColumnRenamed("_u", "_q")
        top //= fan
    return d.select(key, "n", F.col("hash").alias("combined"))


# -- numbers --------------------------------------------------------------------------------------


def nat_minus(a: Column, b: Column) -> Column:
    """Subtraction cut at 0."""
    return F.greatest(a - b, F.lit(0).cast("long"))


def float_eq(a: Column, b: Column) -> Column:
    """IEEE equality: NaN is not equal to itself."""
    return ~F.isnan(a) & ~F.isnan(b) & (a == b)


def float_le(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a <= b)


def float_lt(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def is_infinite(a: Column) -> Column:
    return F.abs(a) == float("inf")


def is_negative_zero(a: Column) -> Column:
    return (a == 0) & F.startswith(a.cast("string"), F.lit("-"))


def is_safe_integer(a: Column) -> Column:
    """A whole number of magnitude below 2^53."""
    return ~F.isnan(a) & (F.abs(a) <= float(2**53 - 1)) & (a == F.rint(a))


def to_integer(a: Column, how: str) -> Column:
    """round (half to even), floor or ceiling as a long; null for NaN and infinities."""
    f = {"round": F.rint, "floor": F.floor, "ceiling": F.ceil}[how]
    return F.when(~F.isnan(a) & ~is_infinite(a), f(a).cast("long"))


PARTS = "struct<numerator:string,denominator:string,mantissa:long,exponent:long,bits:long>"


def _parts(a: pd.Series) -> pd.DataFrame:
    rows = []
    for x in a.astype("float64"):
        bits = int(np.float64(x).view(np.int64))
        if np.isnan(x):
            rows.append(("0", "0", None, None, bits))
        elif np.isinf(x):
            rows.append(("1" if x > 0 else "-1", "0", None, None, bits))
        else:
            n, d = float(x).as_integer_ratio()
            m, e = n, 1 - d.bit_length()
            while m and m % 2 == 0:
                m, e = m // 2, e + 1
            rows.append((str(n), str(d), m, e if m else 0, bits))
    out = pd.DataFrame(rows, columns=["numerator", "denominator", "mantissa", "exponent", "bits"])
    return out.astype({"mantissa": "Int64", "exponent": "Int64"})


def float_parts(a: Column) -> Column:
    """A struct: the exact ratio as decimal strings (NaN is 0/0, infinities are 1/0 and -1/0), the odd mantissa and exponent (0, 0 for zero; null for NaN and
    infinities), and the bit pattern."""

    @F.pandas_udf(PARTS)
    def parts(a: pd.Series) -> pd.DataFrame:
        return _parts(a)

    return parts(a)


def encode_float(mantissa: Column, exponent: Column) -> Column:
    return mantissa.cast("double") * F.pow(F.lit(2.0), exponent.cast("double"))


#: Float functions by name.
FLOAT_MATH = {n: getattr(F, n) for n in ("sqrt", "exp", "log", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")}
#: Character classes by name.
CLASSES = {"lower": r"\p{Ll}", "digit": "[0-9]", "alpha": r"\p{L}", "space": r"\s", "ascii": r"[\x00-\x7F]", "latin1": r"[\x00-\xFF]", "print": r"[^\p{C}  ]", "hex": "[0-9A-Fa-f]"}


def class_counts(s: Column) -> dict[str, Column]:
    """How many characters of a string are in each class."""
    return {n: F.regexp_count(s, F.lit(p)).cast("long") for n, p in CLASSES.items()}


def uncons(s: Column) -> Column:
    """struct(head, tail); null for an empty string."""
    return F.when(s != "", F.struct(F.substr(s, F.lit(1), F.lit(1)).alias("head"), F.substr(s, F.lit(2)).alias("tail")))


def coverage_gaps(known: DataFrame, exempt: DataFrame, outputs: DataFrame, pattern: str) -> DataFrame:
    """(name): known names that are neither exempt nor found by the pattern (first group) in outputs(text)."""
    found = outputs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name")).distinct()
    return known.select("name").distinct().join(exempt.select("name"), "name", "left_anti").join(found, "name", "left_anti")
