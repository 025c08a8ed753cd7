"""Reading input tables and cutting lineage through the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Tables in the shared folder that are still there.
_written: list[str] = []
#: Their names, of those that are dealt into buckets.
_named: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own if the executors run
    in this process, else ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which clean() deletes."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a cut in the lineage
    that survives lost executors and gives the optimizer true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    _written.append(path)
    return out


def materialize_counting(df: DataFrame, counted: Column) -> tuple[DataFrame, int]:
    """materialize(), and how many of its rows satisfy a condition, counted while they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count_if(counted).alias("n")))
    return out, seen.get.get("n", 0)


def bucketed(df: DataFrame, *keys: str, dealt: bool = False, counted: Column | None = None) -> DataFrame | tuple[DataFrame, int]:
    """materialize(), dealt into buckets by keys: joins and groupings on these keys read it as it lies, without a shuffle. There are
    as many buckets as shuffle partitions, so the other side of a join is dealt to match. dealt: df comes out of a join or grouping on keys.
    counted: as in materialize_counting()."""
    spark = df.sparkSession
    path, name = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}", f"tessera_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = Observation()
    df = df if counted is None else df.observe(seen, F.count_if(counted).alias("n"))
    # dealt by the same hash as the buckets, so that a task writes one file
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._tessera_path, out._tessera_name = path, name
    _written.append(path)
    _named[path] = name
    return out if counted is None else (out, seen.get.get("n", 0))


def undealt(df: DataFrame) -> DataFrame:
    """What bucketed() wrote for df as a plain table. A union of tables must not count on their buckets."""
    return df.sparkSession.read.schema(df.schema).parquet(df._tessera_path)


class Grown:
    """A table that rows are added to. FAN parts of equal age are merged, so n additions leave some FAN log n parts, and every row
    is written about log n times at most."""

    FAN = 4

    def __init__(self, first: DataFrame):
        self.parts: list[tuple[DataFrame, int]] = [(first, 1)]

    def add(self, part: DataFrame) -> None:
        """part is a written table; it is not deleted before the next but one addition."""
        self.parts.append((part, 1))
        while len(self.parts) > self.FAN:
            old, n = [d for d, _ in self.parts[-self.FAN - 1 : -1]], [n for _, n in self.parts[-self.FAN - 1 : -1]]
            if len(set(n)) > 1:
                break
            self.parts[-self.FAN - 1 : -1] = [(self.merged(old), sum(n))]
            for d in old:
                self.drop(d)

    def drop(self, part: DataFrame) -> None:
        """part has been merged."""
        release(part)

    def merged(self, parts: list[DataFrame]) -> DataFrame:
        return materialize(reduce(DataFrame.unionByName, parts))

    def view(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p for p, _ in self.parts])


def _delete(spark: SparkSession, path: str) -> None:
    if path in _named:
        spark.sql(f"drop table if exists {_named.pop(path)}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame | None) -> None:
    """Delete what materialize() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path in _written:
        _delete(df.sparkSession, path)
        _written.remove(path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that materialize() wrote in this process: for when the results have been written or read."""
    while _written:
        _delete(spark, _written.pop())
