"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are cut into LISTS slices; a row's score is the sum of its scores in the slices. Each
slice of each block of rows is a score list, in a task of its own that holds that slice only.

1. Every list gives its k highest entries. The most promising of a query's entries, over all lists, are
   scored in full, and the k-th best of these totals is a safe cutoff: the true k-th score is not below it.
2. The cutoff goes back with the queries. A row that reaches it must reach cutoff / LISTS in some list
   (else its sum would be lower), so each list gives its entries from that threshold on, and no others move.
   The k-th best of the rows that all lists gave raises the cutoff. An entry seen in some lists only is
   bounded by what was seen plus, for each other list, just less than the threshold; entries bounded
   below the cutoff go.
3. What remains is scored exactly, and the k best of each block are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .blocks import Vectors, best, matrix, past_blocks, stored, to_every_block

LISTS = 2
#: The greatest score that a result can hold; the least is taken as its negative.
MOST = 2**63 - 1
#: Entries of a query that are scored in full for the first cutoff, in terms of k (any k or more would be safe).
PROBES = 16


def _longest(x: np.ndarray) -> float:
    return float(np.sqrt((x * x).sum(1).max(initial=0.0))) * (1 + 1e-9)


def _products(q: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of whole vectors, none of whose sums exceeds bound: doubles below 2^53, 64-bit numbers below 2^63, and Python's
    integers beyond."""
    if bound < 2**53:
        return q @ x.T
    if bound < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    # each number through int: a double beyond 64 bits is a whole number of its own
    whole = [np.frompyfunc(int, 1, 1)(m) for m in (q, x)]
    return whole[0] @ whole[1].T


def _within(scores: np.ndarray, most: int) -> np.ndarray:
    """64-bit scores, those beyond most, or below -most, as these."""
    if scores.dtype == object:
        scores = np.clip(scores, -most, most)
    return scores.astype(np.int64)


def _kth(totals: DataFrame, k: int) -> DataFrame:
    """(id, cutoff): the k-th highest total of each query; queries with fewer have none."""
    order = W.partitionBy("id").orderBy(F.desc("total"))
    return totals.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).select("id", F.col("total").alias("cutoff"))


class Search:
    """One search; its phases' tables can be counted apart."""

    def __init__(self, df: DataFrame, k: int, vec_id: str, vec: str, lists: int, every: int):
        self.k, self.lists = k, lists
        self.rows: Vectors = stored(df, vec_id, vec)
        # whole numbers that may be null come to pandas as doubles: queries have all columns of rows, and what they may lack is an array
        self.queries = self.rows.query_rows(every).select(F.col("rid").alias("id"), "rid", F.col("id").alias("of"), "vec")
        #: An entry of a list is not told beyond this, so that the lists' sums fit 64 bits; one that reaches it is kept and scored.
        self.most = MOST // lists
        at = np.linspace(0, self.rows.dim, lists + 1).astype(int).tolist()
        self.cuts = list(zip(at, at[1:]))

    def _sliced(self, d: DataFrame, *more: str) -> DataFrame:
        """One row for each list: block is the list's number."""
        parts = F.array(*[F.struct(F.lit(s).alias("s"), F.slice("vec", a + 1, b - a).alias("vec")) for s, (a, b) in enumerate(self.cuts)])
        return d.select("id", "block", *more, F.explode(parts).alias("p")).select("id", *more, (F.col("block") * self.lists + F.col("p.s")).alias("block"), "p.vec")

    def _from_lists(self, queries: DataFrame, pick) -> DataFrame:
        """(id, list, rids, scores) of pick(scores, row of the query frame) -> positions, on each list."""
        most = self.most

        def build(b: pd.DataFrame) -> tuple:
            x = matrix(b["vec"])
            return b["rid"].to_numpy(np.int64), x, _longest(x), int(b["block"].iat[0])

        def answer(block: tuple, a: pd.DataFrame) -> pd.DataFrame:
            rids, x, high, number = block
            q, out = matrix(a["vec"]), []
            scores = _within(_products(q, x, _longest(q) * high), most)
            for j, own in enumerate(a["id"]):
                at = pick(scores[j], rids != own, a["least"].iat[j] if "least" in a else ())
                if len(at):
                    out.append((own, number, rids[at].tolist(), scores[j][at].tolist()))
            return pd.DataFrame(out, columns=["id", "list", "rids", "scores"])

        rows = self._sliced(self.rows.table, "rid")
        more = [c for c in queries.columns if c not in ("id", "of", "vec")]  # rid among them
        asked = self._sliced(to_every_block(queries, self.rows.blocks), *more)
        return past_blocks(rows, asked, self.rows.blocks * self.lists, build, answer, "id long, list int, rids array<long>, scores array<long>")

    def first_lists(self) -> DataFrame:
        """Phase 1: the k highest entries of every list."""
        k = self.k

        def pick(scores, others, _):
            at = np.flatnonzero(others)
            return at if len(at) <= k else at[np.argpartition(scores[at], len(at) - k)[len(at) - k :]]

        return self._from_lists(self.queries, pick)

    def first_cutoff(self) -> DataFrame:
        """(id, cutoff) from the most promising entries of phase 1."""
        seen = self.first_lists().select("id", F.explode(F.arrays_zip("rids", "scores")).alias("e")).groupBy("id", F.col("e.rids").alias("rid")).agg(F.max("e.scores").alias("part"))
        order = W.partitionBy("id").orderBy(F.desc("part"), "rid")
        probes = seen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= PROBES * self.k).select("id", "rid")
        vectors = self.rows.table.select("rid", F.col("vec").alias("other"))
        pairs = probes.join(vectors, "rid").join(self.queries.drop("rid"), "id").select("id", "vec", "other")
        most = self.most * self.lists  # a cutoff below the true one is safe

        def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for q, x in zip(b["vec"], b["other"]):
                    q, x = q[None], x[None]
                    out.append(int(_within(_products(q, x, _longest(q) * _longest(x)), most)[0, 0]))
                yield pd.DataFrame({"id": b["id"], "total": np.array(out, np.int64)})

        return _kth(pairs.mapInPandas(totals, "id long, total long"), self.k)

    def collected(self, cutoffs: DataFrame) -> DataFrame:
        """Phase 2: entries from cutoff / lists on, of every list; all of them where there is no cutoff."""
        rest = F.expr(f"cutoff % {self.lists} > 0").cast("long")
        known = F.array_compact(F.array(F.expr(f"cutoff div {self.lists}") + rest))
        least = self.queries.join(cutoffs, "id", "left").select("id", "rid", "vec", known.alias("least"))

        def pick(scores, others, least):
            return np.flatnonzero(others & (scores >= least[0]) if len(least) else others)

        return self._from_lists(least, pick)

    def resolved(self, entries: DataFrame, cutoffs: DataFrame) -> DataFrame:
        """Phase 3: (query, query_id, vec_id, score, fits), the k best of each block among the entries that can still reach the cutoff. A score
        beyond 64 bits does not fit and is told as the nearest that does."""
        lists, k, most = self.lists, self.k, self.most
        each = entries.select("id", F.explode(F.arrays_zip("rids", "scores")).alias("e")).groupBy("id", F.col("e.rids").alias("rid")).agg(F.sum("e.scores").alias("total"), F.count("*").alias("n"), F.max(F.abs("e.scores")).alias("size"))
        # a total is true where no list told a bounded entry
        raised = _kth(each.where((F.col("n") == lists) & (F.col("size") < most)), k).withColumnRenamed("cutoff", "higher")
        bounds = cutoffs.join(raised, "id", "left").select("id", F.array("cutoff", F.greatest("cutoff", F.coalesce("higher", "cutoff"))).alias("cut"))
        block = (F.col("list") / lists).cast("int")
        wanted = entries.groupBy("id", block.alias("block")).agg(F.collect_list(F.struct("rids", "scores")).alias("lists"))
        asked = wanted.join(self.queries, "id").join(bounds, "id", "left")

        def build(b: pd.DataFrame) -> tuple:
            order = np.argsort(b["rid"].to_numpy(np.int64))
            return b["rid"].to_numpy(np.int64)[order], b["id"].to_numpy(np.int64)[order], matrix(b["vec"])[order]

        def answer(block: tuple, a: pd.DataFrame) -> pd.DataFrame:
            rids, ids, x = block
            out = []
            for own, of, q, got, cut in zip(a["id"], a["of"], a["vec"], a["lists"], a["cut"]):
                seen = np.concatenate([g["rids"] for g in got])
                part = np.concatenate([g["scores"] for g in got])
                rid, where = np.unique(seen, return_inverse=True)
                if cut is not None:
                    cutoff, higher = map(int, cut)
                    total, n = np.zeros(len(rid), np.int64), np.bincount(where)
                    np.add.at(total, where, part)
                    beyond = np.zeros(len(rid), bool)
                    beyond[where[np.abs(part) >= most]] = True
                    # in Python's integers: totals and bounds may come near 64 bits
                    reach = total.astype(object) + (lists - n).astype(object) * (-(-cutoff // lists) - 1) >= higher
                    rid = rid[reach.astype(bool) | beyond]
                at = np.searchsorted(rids, rid)
                q, held = q[None], x[at]
                exact = _products(q, held, _longest(q) * _longest(held))[0]
                fits = ((exact >= -MOST) & (exact <= MOST)).astype(bool) if exact.dtype == object else np.ones(len(at), bool)
                exact = _within(exact, MOST)
                top = best(exact, ids[at], k)
                out.append((own, of, ids[at[top]], exact[top], fits[top]))
            if not out:
                return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": [], "fits": []})
            own, of, found, scores, fit = zip(*out)
            n = [len(t) for t in found]
            return pd.DataFrame({"query": np.repeat(own, n), "query_id": np.repeat(of, n), "vec_id": np.concatenate(found), "score": np.concatenate(scores), "fits": np.concatenate(fit)})

        rows = self.rows.table.withColumn("of", F.col("id"))
        return past_blocks(rows, asked, self.rows.blocks, build, answer, "query long, query_id long, vec_id long, score long, fits boolean")


def top_k(df: DataFrame, k: int = 20, vec_id: str = "vec_id", vec: str = "vec", lists: int = LISTS, every: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): the k highest inner products of each query (rows
    whose vec_id is divisible by every) with every row but its own; ties to smaller ids.

    vec holds whole numbers. Rows whose vector is null or holds null or non-finite numbers take no part, nor do
    rows without an id. A vector shorter than the longest counts as zero beyond its end, an empty one as zero.
    Repeated rows are candidates each, and queries each, so an id that several rows share has as many answers. Other columns are not read; an
    empty table gives no rows. Products are exact at any size; ArithmeticError only if a score of the result itself does not fit 64 bits.
    """
    search = Search(df, k, vec_id, vec, lists, every)
    cutoffs = materialize(search.first_cutoff())
    entries = materialize(search.collected(cutoffs))
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = search.resolved(entries, cutoffs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = materialize(found.select("query_id", "rank", "vec_id", "score", "fits"))
    if not found.where(~F.col("fits")).isEmpty():
        raise ArithmeticError("one of the highest inner products does not fit 64-bit integers")
    return found.drop("fits")
