"""Hierarchical multi-length packing of token sequences.

Context sizes are tiers: 1024, 512, ... 1. Each document's ids fill whole windows of the longest
tier; what remains is routed to the smallest tier that holds it. From the longest tier to the shortest,
each packs its remainders one to a window and fills each window's gap with remainders of shorter tiers,
the largest that fits first; a gap that none fits is closed by cutting a piece off the shortest
remainder, whose end is routed anew. Only a buffer's last window can lack a filling: it is split into
shorter tiers, so nothing is padded. Sequences of all tiers of a buffer are dealt to step groups of near
equal token counts.

Tokens are made and packed in one pass over the input partitions, in buffers of bounded size: there
is no shuffle, and tokens never leave their task.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WINDOW = 1024
#: Tokens held by one packing buffer, and words remembered by a tokenizer.
BUFFER_TOKENS, CACHE_WORDS, GROUP = 1_500_000, 450_000, 64
STEP_TOKENS = 16 * WINDOW
#: The pattern by which byte-level pre-tokenization splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER_SPACE = re.compile(r"[^\S \n]")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


def _ranks(model: dict) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE model by bytes; None if its merges aren't in the order of ids."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
    alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if all(c in alphabet for c in token)}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return vocab if merged == sorted(merged) and sum(len(t) == 1 for t in vocab) == 256 else None


class WordCachingTokenizer:
    """Ids of whole texts, as the tokenizers library gives them for a byte-level BPE file, as little-endian unsigned
    32-bit bytes.

    The split pattern never matches across a single space between two non-space characters (it only
    ever takes the space into the match that follows it), and neither do special tokens, so such words are encoded
    apart and remembered; a text with any other white space next to a space is encoded whole. Words not yet known
    of a group of texts are encoded in one call of a faster library that is given the file's vocabulary, and told apart by their byte
    counts; words and texts with special tokens go through tokenizers.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        plain = plain and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        ranks = _ranks(spec["model"]) if plain else None
        if ranks is None:
            raise ValueError("not a plain byte-level BPE file")
        self.quick = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return _bytes(self.library.encode(text, add_special_tokens=False).ids if self.special.search(text) else self.quick(text))

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of these words, each after a space."""
        ids = np.array(self.quick(" " + " ".join(words)), "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = [0, *(np.searchsorted(np.cumsum(self.size[ids]), ends) + 1).tolist()]
        blob = ids.tobytes()
        self.known.update((w, blob[4 * i : 4 * j]) for w, i, j in zip(words, cuts, cuts[1:]))

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null."""
        split = [t.split(" ") if t and not ("  " in t or "\n " in t or " \n" in t or t[0] == " " or t[-1] == " " or OTHER_SPACE.search(t)) else None for t in texts]
        firsts, tails = [w[0] if w else None for w in split], [w[1:] if w else [] for w in split]
        words = set().union(*tails)
        if missing := words.difference(self.known):
            if len(self.known) + len(missing) > CACHE_WORDS:
                self.known.clear()
                missing = words
            marked = set(filter(self.special.search, missing))
            if missing - marked:
                self._learn(list(missing - marked))
            self.known.update((w, self.encode(" " + w)) for w in marked)
        get = self.known.__getitem__
        return [(self.encode(t) if t else b"") if w is None else self.encode(w) + b"".join(map(get, tail)) for t, w, tail in zip(texts, firsts, tails)]


@lru_cache(maxsize=1)
def tokenizer_for(path: str) -> WordCachingTokenizer:
    """One for each Python worker, so that what it remembers serves all of the worker's tasks."""
    return WordCachingTokenizer(path)


def plan(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document number, start, length), each within window, over all ids of documents
    of these lengths. Every sequence is exactly a window or a smaller power of two long."""
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []  # (length, document, start): sorted, the tiers' pools in a row
    for d, n in enumerate(lengths):
        cut = n - n % window
        full += [[(d, s, window)] for s in range(0, cut, window)]
        if n > cut:
            rest.append((n - cut, d, cut))
    rest.sort()
    while rest:
        length, d, s = rest.pop()
        tier = min(window, 1 << (length - 1).bit_length())  # the smallest that holds it
        seq, gap = [(d, s, length)], tier - length
        while gap and rest:
            i = bisect_right(rest, (gap, 1 << 60, 0)) - 1
            if i >= 0:  # the largest that fits whole; gap < tier / 2, so it is of a shorter tier
                n, d, s = rest.pop(i)
                seq.append((d, s, n))
                gap -= n
            else:  # all are longer: cut the shortest, whose end is routed anew
                n, d, s = rest.pop(0)
                seq.append((d, s, gap))
                left = (n - gap, d, s + gap)
                rest.insert(bisect_right(rest, left), left)
                gap = 0
        full += [seq] if not gap else _tail(seq, tier)
    return full


def _tail(pieces: list[tuple[int, int, int]], tier: int) -> list[list[tuple[int, int, int]]]:
    """The last pieces of a buffer, less than a window of this tier, in windows of the shorter tiers."""
    tail, out = list(pieces), []
    total = sum(n for _, _, n in tail)
    while total:
        tier //= 2
        if total >= tier:
            seq, gap = [], tier
            while gap:
                d, s, n = tail.pop(0)
                take = min(n, gap)
                seq.append((d, s, take))
                if n > take:
                    tail.insert(0, (d, s + take, n - take))
                gap -= take
            out.append(seq)
            total -= tier
    return out


def _emit(ids: list[int | None], tokens: list[bytes], first: int, groups: int, window: int) -> tuple[pd.DataFrame, int, int]:
    sequences = plan([len(t) // 4 for t in tokens], window)
    sizes = np.array([sum(n for _, _, n in seq) for seq in sequences])
    # step groups: sequences in falling order of size, each window-sized run of tokens to the next group
    n_groups = max(1, round(int(sizes.sum()) / STEP_TOKENS))
    order = np.argsort(-sizes, kind="stable")
    lap, place = np.divmod(np.arange(len(order)), n_groups)
    group = np.empty(len(order), np.int64)
    group[order] = np.where(lap % 2 == 0, place, n_groups - 1 - place) + groups
    rows = []
    for k, seq in enumerate(sequences):
        offset = 0
        for d, s, n in seq:
            rows.append((ids[d], s, n, zlib.crc32(tokens[d][4 * s : 4 * (s + n)]), len(tokens[d]) // 4, first + k, offset, int(sizes[k]), int(group[k])))
            offset += n
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out, first + len(sequences), groups + n_groups


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, start (the document's ids before it), length, ids_crc32 (of its
    ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset (in its sequence),
    tier (the sequence's size, a power of two) and step_group.

    A document's ids are those that the tokenizers library gives its text by the file tokenizer_path, special tokens in the
    text included, then end_id. A null or empty text has end_id alone; a null id and
    repeated rows are packed like others; an empty table gives no rows. Sequence and group numbers
    are unique, in blocks by input partition. Only the two columns named are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = tokenizer_for(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        first = groups = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        ids, tokens, held = [], [], 0
        for pdf in batches:
            for i in range(0, len(pdf), GROUP):
                part = pdf.iloc[i : i + GROUP]
                for d, t in zip(part["doc_id"], tokenizer.ids_of(list(part["text"]))):
                    tokens.append(t + end)
                    ids.append(None if pd.isna(d) else int(d))
                    held += len(tokens[-1]) // 4
                if held >= BUFFER_TOKENS:
                    out, first, groups = _emit(ids, tokens, first, groups, window)
                    yield out
                    ids, tokens, held = [], [], 0
        if ids:
            yield _emit(ids, tokens, first, groups, window)[0]

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, SCHEMA)
