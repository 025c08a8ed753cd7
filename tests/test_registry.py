"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import pytest

from tessera.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got)
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    assert a == b and a


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_works_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_whole_queries_see_every_edge(spark, con):
    edges = con.execute(ORACLE_SQL["p3_transpose_whole"]).fetchall()
    assert QUERIES["p3_transpose_whole"](spark, SF).count() == len(edges) > 2 * QUERIES["p3_transpose"](spark, SF).count()
    after = {}
    for dst, src, _ in edges:  # transposed
        after.setdefault(src, []).append(dst)
    start = min(after)
    best, level = {start: [start]}, [start]
    while level:
        found = {}
        for x in level:
            for y in after.get(x, []):
                if y not in best:
                    found[y] = min(found.get(y, [*best[x], y]), [*best[x], y])
        best |= found
        level = list(found)
    assert {r["id"]: list(r["path"]) for r in QUERIES["g2_shortest_paths_whole"](spark, SF).collect()} == best


@pytest.fixture(scope="module")
def odd_names(spark, tmp_path_factory):
    """A folder with part of 300 names, a hundred to a brand, and what they are."""
    names = [None, "", "red", "red ring", "ring red", "redred", "ÄÖ ß", "日本", "日本語", " red", *(f"name {i} red" for i in range(290))]
    sf = str(tmp_path_factory.mktemp("names"))
    rows = [(i, n, f"Brand#{i % 3}", "T", i % 50) for i, n in enumerate(names * 2)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{sf}/part.parquet")
    return sf, names


def test_common_parts_of_every_pair_of_names(spark, odd_names):
    sf, names = odd_names
    got = {(r["a"], r["b"]): (r["prefix"], r["suffix"], r["stripped"], r["rest"]) for r in QUERIES["t8_common_parts"](spark, sf).collect()}
    assert len(got) == len(names) ** 2 == QUERIES["t8_common_parts"](spark, sf).count()

    def want(a, b):
        if a is None or b is None:
            return None if a is None else "", None if a is None else "", None, a[3:] if a and a.startswith("red") else None
        prefix, suffix = os.path.commonprefix([a, b]), os.path.commonprefix([a[::-1], b[::-1]])[::-1]
        return prefix, suffix, a[: len(a) - len(b[-4:])] if a.endswith(b[-4:]) else None, a[3:] if a.startswith("red") else None

    assert got == {(a, b): want(a, b) for a in names for b in names}


def test_common_parts_pair_all_names_of_the_smallest_table(spark, con):
    n = con.execute("select count(distinct p_name) from part").fetchone()[0]
    assert QUERIES["t8_common_parts"](spark, SF).count() == n * n == con.execute(f"select count(*) from ({ORACLE_SQL['t8_common_parts']})").fetchone()[0]


def test_overlap_of_every_pair_of_names(spark, odd_names):
    sf, names = odd_names
    rows = QUERIES["t9_find_overlap"](spark, sf).collect()
    got = {(r["a"], r["b"]): (r["start"], r["length"]) for r in rows}
    assert len(got) == len(names) ** 2 == len(rows)

    def want(a, b):
        if a is None or b is None:
            return None, None
        start = next(i for i in range(len(a) + 1) if b.startswith(a[i:]))
        return start, len(a) - start

    assert got == {(a, b): want(a, b) for a in names for b in names}


def test_overlaps_pair_all_names_of_the_smallest_table(spark, con):
    n = con.execute("select count(distinct p_name) from part").fetchone()[0]
    assert QUERIES["t9_find_overlap"](spark, SF).count() == n * n == con.execute(f"select count(*) from ({ORACLE_SQL['t9_find_overlap']})").fetchone()[0]
