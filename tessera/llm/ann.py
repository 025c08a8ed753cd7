"""Approximate nearest neighbours by a hash-prefix forest.

Each of TREES trees has a long hash string for every vector: CHARS characters, each the number of the
coordinate (signed, of DIMS) that is largest after a random projection, so near vectors share long
prefixes. A tree is the sorted array of its strings. A query descends in every tree to its longest
matching prefix, which differs from tree to tree; then all trees ascend together, one character at a
time from the deepest match, each adding the rows that share the now shorter prefix, tree after tree, until enough
different candidates are found. The empty prefix, which all rows share, is no match: it counts only where all trees together leave
fewer rows than are asked for. Candidates are ranked by their true inner product.

Vectors of unequal length are first lifted by one coordinate to the length of the longest, which turns
the largest inner product into the smallest angle. The index is built over every row: a block of rows is
a forest of its own, built once by the task that holds the block, and all queries stream past it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import best, matrix, past_blocks, stored, to_every_block

TREES, CHARS, DIMS, SEED = 120, 8, 64, 11
#: Candidates to gather in a block, as a share of its rows: vectors without any cluster structure in 64
#: dimensions need this much for a recall well above 0.9.
SHARE = 0.4

#: Bits of a character: a coordinate of at most 64 and a sign.
BITS = 7


def strings(x: np.ndarray, trees: int, chars: int, seed: int = SEED) -> np.ndarray:
    """Hash strings (trees, rows, chars) of characters below 2 * DIMS."""
    rng = np.random.default_rng(seed)
    dims = min(DIMS, x.shape[1])
    out = np.empty((trees, len(x), chars), np.uint8)
    for t in range(trees):
        for c in range(chars):
            y = x @ rng.standard_normal((x.shape[1], dims)).astype(np.float32)
            j = np.abs(y).argmax(1)
            out[t, :, c] = 2 * j + (y[np.arange(len(x)), j] < 0)
    return out


def _as_numbers(s: np.ndarray) -> np.ndarray:
    """Strings of up to 8 characters, of 7 bits each, as numbers that sort alike."""
    return sum(s[..., c].astype(np.int64) << (BITS * (s.shape[-1] - 1 - c)) for c in range(s.shape[-1]))


class Forest:
    """Sorted arrays of the hash strings of a block's rows."""

    def __init__(self, x: np.ndarray, trees: int, chars: int, seed: int = SEED):
        self.size, self.chars = len(x), chars
        codes = _as_numbers(strings(x, trees, chars, seed))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (chars + 1, trees, queries) of the rows that share each prefix length."""
        lo = np.empty((self.chars + 1, *codes.shape), np.int64)
        hi = np.empty_like(lo)
        for depth in range(self.chars + 1):
            shift = BITS * (self.chars - depth)
            for t, own in enumerate(self.sorted):
                lo[depth, t] = np.searchsorted(own, codes[t] >> shift << shift, "left")
                hi[depth, t] = np.searchsorted(own, ((codes[t] >> shift) + 1 << shift), "left")
        return lo, hi

    def candidates(self, lo: np.ndarray, hi: np.ndarray, least: int, fewest: int) -> np.ndarray:
        """Rows for one query, bounds (chars + 1, trees): descend, then ascend together, a tree at a time within a step, until there
        are enough. All rows, if those that share a character in any tree are fewer than fewest."""
        marked = np.zeros(self.size, bool)
        for depth in range(self.chars, 0, -1):
            for t in np.flatnonzero(hi[depth] > lo[depth]):
                own = self.order[t, lo[depth, t] : hi[depth, t]]
                marked[own] = True
                if len(own) > 1 and np.count_nonzero(marked) >= least:
                    return np.flatnonzero(marked)
        return np.flatnonzero(marked) if np.count_nonzero(marked) >= fewest else np.arange(self.size)


def search(df: DataFrame, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", every: int = 20, trees: int = TREES, chars: int = CHARS, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (double), scored (long): for each query (rows whose vec_id is divisible by
    every) the k nearest found among every row but the query's own, by inner product of the original
    vectors in double precision, ties to smaller ids. scored: how many rows were ranked for the query in the block that this one is from, of block_rows.

    Rows whose vector is null, zero, empty, or holds null or non-finite numbers take no part, nor do
    rows without an id. A vector shorter than the longest counts as zero beyond its end. Repeated rows are
    candidates each, and queries each, so an id that several rows share has as many answers. A query has fewer than k rows only if there are no more
    candidates. Other columns are not read; an empty table gives no rows.
    """
    rows = stored(df, vec_id, vec, lambda v: F.exists(v, lambda x: x != 0))
    longest = rows.longest

    def lifted(x: np.ndarray, is_query: bool) -> np.ndarray:
        n = (x * x).sum(1)
        more = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(longest - n, 0))
        by = np.sqrt(np.maximum(n if is_query else longest, 1e-300))
        return (np.column_stack([x, more]) / np.reshape(by, (-1, 1))).astype(np.float32)

    def build(b: pd.DataFrame) -> tuple:
        x = matrix(b["vec"])
        return b["id"].to_numpy(np.int64), b["rid"].to_numpy(np.int64), x, Forest(lifted(x, False), trees, chars)

    def answer(block: tuple, a: pd.DataFrame) -> pd.DataFrame:
        ids, rids, x, forest = block
        q, of, by = matrix(a["vec"]), a["id"].to_numpy(np.int64), a["rid"].to_numpy(np.int64)
        lo, hi = forest.ranges(_as_numbers(strings(lifted(q, True), trees, chars)))
        least, out = max(8 * k, int(share * len(x))), []
        for j in range(len(q)):
            at = forest.candidates(lo[:, :, j], hi[:, :, j], least, k + 1)
            at = at[rids[at] != by[j]]
            score = x[at] @ q[j]
            top = best(score, ids[at], k)
            out.append((ids[at[top]], score[top], len(at)))
        n = [len(t) for t, _, _ in out]
        return pd.DataFrame({"query": np.repeat(by, n), "query_id": np.repeat(of, n), "vec_id": np.concatenate([t for t, _, _ in out]), "score": np.concatenate([s for _, s, _ in out]), "scored": np.repeat([m for _, _, m in out], n), "block_rows": len(x)})

    asked = to_every_block(rows.query_rows(every), rows.blocks)
    found = past_blocks(rows.table, asked, rows.blocks, build, answer, "query long, query_id long, vec_id long, score double, scored long, block_rows long")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored", "block_rows")
