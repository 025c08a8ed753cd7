"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialize


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the documents that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def ceil_div(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores behind as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Leading bits of a hash by which first_of_each counts before it orders.
BIN_BITS = 12


def first_of_each(texts: DataFrame, kind: str, order: str, most: int) -> DataFrame:
    """At most most rows of each kind, the first in this order; order is a column of 64-bit hashes, kind is not null.

    Rows are counted by kind and the leading BIN_BITS of the hash; only the bins up to that of the last row wanted go on, so
    the task that orders a kind gets most rows and one bin's, a 4096th of the kind, however many partitions there are."""
    at, n = fresh(texts, "bin", "n")
    binned = texts.withColumn(at, F.shiftright(order, 64 - BIN_BITS))
    before = F.sum(n).over(W.partitionBy(kind).orderBy(at).rowsBetween(W.unboundedPreceding, -1))
    counts = binned.groupBy(kind, at).agg(F.count("*").alias(n)).withColumn(n, F.coalesce(before, F.lit(0)))
    some = binned.join(counts.where(F.col(n) < most), [kind, at], "left_semi")
    place = F.row_number().over(W.partitionBy(kind).orderBy(order))
    return some.withColumn(n, place).where(F.col(n) <= most).drop(at, n)


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows, written, with their places from 1 in this order, without gaps; equal rows get different places.

    The order is dealt by ranges and sorted; a place is that in its partition after the sizes of the partitions before it. Only
    one count for each partition is gathered."""
    part, at, before = fresh(rows, "part", "at", "before")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    own = materialize(own.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    upto, offsets = 0, []
    for r in own.groupBy(part).count().orderBy(part).collect():
        offsets.append((r[0], upto))
        upto += r[1]
    table = own.sparkSession.createDataFrame(offsets, f"{part} int, {before} long")
    return own.join(F.broadcast(table), part).withColumn(name, F.col(before) + F.col(at) + 1).select(*rows.columns, name)
