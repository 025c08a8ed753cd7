"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments A, B, C of 21, 21 and 22 bits, each padded to a word of
the perfect binary Golay code of length 23: every word has exactly one codeword within 3 bits.
Write dec(w) for that codeword's index (12 bits) and near(w) for the indices of all codewords within
4 bits (1 or 6 of them). If two words differ in at most one bit, dec of one lies in near of the other.

Two fingerprints that differ in 3 bits or fewer spread these errors over the segments, so (pigeonhole)
either one segment i is equal and another, j, differs in at most one bit: they meet on the key
(i's bits, dec(j)) of one and (i's bits, near(j)) of the other, 33 or more bits wide;
or all three differ in one bit: they meet on (dec(A), near(B), dec(C)) of one and
(near(A), dec(B), near(C)) of the other, 36 bits wide. Keys are joined, each candidate pair is
verified on all 64 bits, and links are closed into components. Every link is found.

Equal texts and equal fingerprints are grouped before any key is made. A key that very many
fingerprints share is not expanded into pairs by the join: its members are dealt into blocks, and
each pair of blocks gives only a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.tables import materialize
from .common import ceil_div, fresh

#: The code's generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1, segment widths and shifts.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS, SEED = 3, 42
#: Members of a key beyond which it is worked in blocks of this many.
BLOCK = 512
#: Fingerprints of which one task makes keys, and of which it makes them at a time.
PRINTS, AT_ONCE = 16_384, 1024

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# -- fingerprints ---------------------------------------------------------------------------------


def words_of(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased."""
    return text.encode().translate(_LOWER).split()


def shingles_of(words: list[bytes], k: int) -> list[bytes]:
    """All runs of k words, repeats included; the whole sequence if there are fewer words."""
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def fingerprint_of(text: str | None, k: int) -> int:
    """The 64-bit SimHash, as a signed integer; 0 for no words."""
    shingles = shingles_of(words_of(text), k) if text else []
    if not shingles:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 65536):  # bounded memory for very long texts
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles[i : i + 65536]])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """docs with the column fingerprint (long); a column of that name is replaced."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint_of(t, words) for t in s], dtype="int64")

    return docs.drop("fingerprint").withColumn("fingerprint", of(F.col(text)))


# -- the code -------------------------------------------------------------------------------------


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each power x^i by the generator, and the error pattern of each remainder."""
    rest = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for b in range(i, 10, -1):
            if r >> b & 1:
                r ^= GENERATOR << (b - 11)
        rest[i] = r
    errors = np.zeros(2048, np.int64)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                bits = {i, j, k}
                errors[np.bitwise_xor.reduce([rest[b] for b in bits])] = sum(1 << b for b in bits)
    errors[0] = 0
    return rest, errors


_REST, _ERRORS = _syndromes()


def decode(w: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within 3 bits of each 23-bit word."""
    syndrome = np.zeros_like(w)
    for i in range(23):
        syndrome ^= (w >> i & 1) * _REST[i]
    return (w ^ _ERRORS[syndrome]) >> 11


def near(w: np.ndarray) -> list[np.ndarray]:
    """Indices of all codewords within 4 bits: for each of 24 slots the index, or -1 if it is a repeat."""
    found = np.stack([decode(w), *(decode(w ^ (1 << i)) for i in range(23))])
    found.sort(axis=0)
    found[1:][found[1:] == found[:-1]] = -1
    return found


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position in fp, side) of every key of these fingerprints (unsigned 64-bit)."""
    part = [(fp >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    dec = [decode(p) for p in part]
    close = []
    for p in part:
        found = near(p)
        slot, at = np.nonzero(found >= 0)
        close.append((at, found[slot, at]))
    out = []
    for i in range(3):
        for j in range(3):
            if i != j:
                family = np.int64(1 + 3 * i + j) << 40
                out.append((family | part[i] << 12 | dec[j], np.arange(len(fp)), 0))
                at, c = close[j]
                out.append((family | part[i][at] << 12 | c, at, 1))
    family = np.int64(12) << 40
    at, b = close[1]
    out.append((family | dec[0][at] << 24 | b << 12 | dec[2][at], at, 0))
    # all of near(A) x near(C) of the same fingerprint
    (at_a, a), (at_c, c) = close[0], close[2]
    order_a, order_c = np.argsort(at_a, kind="stable"), np.argsort(at_c, kind="stable")
    at_a, a, at_c, c = at_a[order_a], a[order_a], at_c[order_c], c[order_c]
    n_c = np.bincount(at_c, minlength=len(fp))
    first = np.cumsum(n_c) - n_c
    times = n_c[at_a]
    left = np.repeat(np.arange(len(at_a)), times)
    step = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    at = at_a[left]
    out.append((family | a[left] << 24 | dec[1][at] << 12 | c[first[at] + step], at, 1))
    return (np.concatenate([k for k, _, _ in out]), np.concatenate([p for _, p, _ in out]), np.concatenate([np.full(len(k), s, np.int8) for k, _, s in out]))


# -- links ----------------------------------------------------------------------------------------


def _forest(a: np.ndarray, b: np.ndarray, bits: int) -> pd.DataFrame:
    """A spanning forest of the links within bits between two blocks of fingerprints."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x in a:
        for y in b[np.bitwise_count(b ^ x) <= bits]:
            if x != y and (p := root(int(x))) != (q := root(int(y))):
                parent[p] = q
                out.append((int(x), int(y)))
    return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")


def links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(src, dst): links between different fingerprints (column fingerprint, distinct, not null) that
    differ in at most bits (3 or fewer) bits. All links but those inside very common keys, of which
    there are enough to connect the same fingerprints."""
    assert bits <= MAX_BITS, "the segments' pigeonhole argument holds up to 3 bits"
    schema = "key long, fingerprint long, side byte"

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), AT_ONCE):
                fp = pdf["fingerprint"].to_numpy()[i : i + AT_ONCE]
                key, at, side = keys_of(fp.view(np.uint64))
                yield pd.DataFrame({"key": key, "fingerprint": fp[at], "side": side})

    # some 70 keys a fingerprint: tasks of PRINTS fingerprints keep what a writer buffers small
    dealt = prints.select("fingerprint").repartition(ceil_div(prints.count(), PRINTS), "fingerprint")
    keys = materialize(dealt.mapInPandas(emit, schema))
    # members are counted by partial sums; only the few common keys with their counts are joined
    hot = materialize(keys.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK))
    rare = keys.join(hot, "key", "left_anti")
    common = keys.join(hot, "key")
    differ = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= bits
    plain = rare.where("side = 0").select("key", "fingerprint").join(rare.where("side = 1").select("key", F.col("fingerprint").alias("other")), "key")
    plain = plain.where((F.col("fingerprint") < F.col("other")) & differ).select(F.col("fingerprint").alias("src"), F.col("other").alias("dst"))

    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    by = ("key", "i", "j")
    a = common.where("side = 0").select("key", own.alias("i"), every.alias("j"), "fingerprint").toDF(*by, "fingerprint")
    b = common.where("side = 1").select("key", every.alias("i"), own.alias("j"), "fingerprint").toDF(*by, "fingerprint")
    shared = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(lambda x, y: _forest(x["fingerprint"].to_numpy(), y["fingerprint"].to_numpy(), bits), "src long, dst long")
    return plain.union(shared)


def _classes(rows: DataFrame, bits: int) -> DataFrame:
    """(fingerprint, least, component) of each fingerprint of the written rows(doc_id, fingerprint): its least id, and the least
    fingerprint that it is linked to."""
    prints = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    edges = materialize(links(prints, bits))
    parts = connected_components(edges).withColumnRenamed("node", "fingerprint")
    return prints.join(parts, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    fingerprint: 16 lower-case hex digits. component_id: the smallest id reachable over links of
    fingerprints that differ in at most bits bits, the row's own included. A null text or one without
    words has the fingerprint zero and is linked like any other; repeated rows stay and share a
    component; rows with a null id are kept, and ids that are null count for no component's minimum;
    an empty table gives no rows. Only the two columns named are read.
    """
    rows = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words).select("doc_id", "fingerprint"))
    grouped = _classes(rows, bits)
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = grouped.select("fingerprint", "component").join(least, "component").select("fingerprint", "component_id")
    return rows.join(of_print, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each component: the one of the smallest id (null ids come last), of rows that share it the one of the
    text with the smallest hash, of rows that repeat both any one. All columns stay, whatever their names."""
    marked = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words)
    rows = materialize(marked.select("doc_id", "fingerprint", F.xxhash64("text").alias("h")))
    of_print = _classes(rows.select("doc_id", "fingerprint"), bits).select("fingerprint", "component")
    same = rows.groupBy("doc_id", "h", "fingerprint").agg(F.count("*").alias("n")).join(of_print, "fingerprint")
    first = same.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "n")).alias("r"))
    i, h, n = fresh(docs, "i", "h", "n")
    first = materialize(first.select(F.col("r.doc_id").alias(i), F.col("r.h").alias(h), F.col("r.n").alias(n)))
    rowwise = docs[doc_id].eqNullSafe(F.col(i)) & (F.xxhash64(docs[text]) == F.col(h))
    single, repeated = (docs.join(first.where(c), rowwise, "left_semi") for c in (F.col(n) == 1, F.col(n) > 1))
    return single.union(repeated.dropDuplicates([doc_id, text]))
