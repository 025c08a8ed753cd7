"""Text sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import format_of, list_entries

#: What a run log says of memory, time and counters.
MEMORY, SECONDS, TICK = r"([0-9]+)\s*MB total memory in use", r"Total\s+time\s+([0-9.]+)s", r"(?m)^\s*{}\s*=?\s*([0-9,]+)\s*$"


def write_whole_texts(df: DataFrame, path: str) -> None:
    """One file for each row of df(name, text), all in one folder: the name on the first line, then the text. Only Spark's writer touches the path."""
    df.select(F.concat("name", F.lit("\n"), "text").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_named_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of what write_whole_texts() wrote; the text ends with a newline of the writer's."""
    at = F.locate("\n", "text")
    return read_whole_texts(spark, path).select(F.substr("text", F.lit(1), at - 1).alias("name"), F.substr("text", at + 1).alias("text"))


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, hash, format): one row a file, its text whole, hashed and its format told by its ending."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.withColumn("hash", F.xxhash64("text")).withColumn("format", format_of(F.col("path")))


def read_list_files(spark: SparkSession, path: str) -> DataFrame:
    return list_entries(read_whole_texts(spark, path).select(F.col("path").alias("file"), "text"))


def benchmark_rows(logs: DataFrame) -> DataFrame:
    """logs(log, case, text) with mem_mb, seconds, metas and constraints: totals of their tick lines."""
    number = lambda p: F.regexp_extract("text", p, 1)
    ticks = lambda name: F.aggregate(F.transform(F.regexp_extract_all("text", F.lit(TICK.format(name)), F.lit(1)), lambda x: F.replace(x, F.lit(",")).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return logs.select("log", "case", F.try_to_number(number(MEMORY), F.lit("999999999")).cast("long").alias("mem_mb"), F.expr(f"try_cast(regexp_extract(text, r'{SECONDS}', 1) as double)").alias("seconds"), ticks("metas").alias("metas"), ticks("constraints").alias("constraints"))


def dot_lines(nodes: DataFrame, edges: DataFrame, name: str = "dependencies") -> DataFrame:
    """(part, a, b, line): a graph as dot text, header, nodes(id, label), edges(src, dst) and footer; order by part, a, b."""
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, None, None, f"digraph {name} {{"), (3, None, None, "}")], "part int, a long, b long, line string")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.format_string('   m%d[label="%s"];', "id", "label").alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.format_string("   m%d -> m%d;", "src", "dst").alias("line"))
    return ends.union(n).union(e)


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    dot_lines(nodes, edges).orderBy("part", "a", "b").select("line").write.text(path)


def annotation_json(segments: DataFrame) -> DataFrame:
    """(grp, start, json): one object a segment(grp, start, end, aspect, others, note, flag, site)."""
    atoms = F.array_compact(F.concat(F.array("aspect"), F.coalesce("others", F.array().cast("array<string>"))))
    return segments.select("grp", "start", F.to_json(F.struct(F.array("start", "end").alias("range"), atoms.alias("atoms"), F.coalesce("flag", F.lit(False)).alias("tokenBased"), F.col("note"), F.col("site").alias("definitionSite"))).alias("json"))


def write_annotations(segments: DataFrame, path: str) -> None:
    annotation_json(segments).orderBy("grp", "start").select("json").write.text(path)


def issue_lines(issues: DataFrame, base_url: str) -> DataFrame:
    """(part, number, line) of listed issues: issues first, then pull requests, newest first in each."""
    kind = F.when(F.col("is_pr"), "PR").otherwise("Issue")
    link = F.concat(F.lit(base_url), F.when(F.col("is_pr"), "/pull/").otherwise("/issues/"), F.col("number").cast("string"))
    line = F.concat(F.lit("- ["), kind, F.lit(" #"), F.col("number").cast("string"), F.lit("]("), link, F.lit("): "), F.col("title"))
    return issues.where("outcome = 'listed'").select(F.col("is_pr").cast("int").alias("part"), "number", line.alias("line"))


def write_issue_list(issues: DataFrame, base_url: str, path: str) -> None:
    issue_lines(issues, base_url).orderBy("part", F.desc("number")).select("line").write.text(path)
