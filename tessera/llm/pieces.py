"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised here by the model's compiled character map, taking the longest prefix that the map
holds at each place, and every normalised character remembers the source bytes it came from. Spaces
become U+2581, with one put before the text. The ids are the merges of this normalised text: the library gets it with its own
normalisation switched off. Where no piece of the model crosses from a character into a following
U+2581, the normalised text falls into segments that are merged one by one and remembered; else it is
merged whole. Each piece is projected back to the bytes of the original text.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE_SEGMENTS = 300_000


# -- the model file -------------------------------------------------------------------------------


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a serialised message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


def _message(number: int, value: bytes | int) -> bytes:
    """One field of a serialised message."""

    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


#: The numbers of fields of a model file (its normaliser; and of that: map, dummy prefix, squeezing of spaces,
#: escaping of spaces), and of the kinds of pieces that are taken as they are.
NORMALIZER, CHARSMAP, DUMMY, SQUEEZE, ESCAPE, USER_DEFINED = 3, 2, 3, 4, 5, 4


def normalizer_of(model: bytes) -> dict:
    """The normaliser's settings in a model file; of fields that are repeated the last one counts."""
    spec = dict(f for k, v in _fields(model) if k == NORMALIZER for f in _fields(v))
    return {"charsmap": spec.get(CHARSMAP, b""), "dummy": bool(spec.get(DUMMY, 1)), "squeeze": bool(spec.get(SQUEEZE, 1)), "escape": bool(spec.get(ESCAPE, 1))}


def with_normalizer(model: bytes, charsmap: bytes, dummy: bool, squeeze: bool) -> bytes:
    """The model with other settings of its normaliser."""
    return model + _message(NORMALIZER, _message(CHARSMAP, charsmap) + _message(DUMMY, int(dummy)) + _message(SQUEEZE, int(squeeze)) + _message(ESCAPE, 1))


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 keys, then the replacements,
    each ended by a zero byte."""

    def __init__(self, blob: bytes):
        n = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{n // 4}I", blob[4 : 4 + n])
        self.texts = blob[4 + n :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that data has at this place."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & ((1 << 31) - 1)
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


def normalize(text: str, spec: dict, charmap: CharMap, whole: re.Pattern | None = None) -> tuple[str, np.ndarray]:
    """The normalised text, and for each of its characters, and its end, the source byte offset. Matches of whole are
    symbols that stay as they are."""
    data, out, at, i = text.encode(), [], [], 0
    stays = {len(text[: m.start()].encode()): m.group() for m in whole.finditer(text)} if whole else {}

    def step() -> tuple[int, str]:
        """Source bytes and normalised text of the longest prefix from here."""
        if i in stays:
            return len(stays[i].encode()), stays[i]
        if found := charmap.longest(data, i):
            return found[0], found[1].decode()
        n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        return n, data[i : i + n].decode()

    space, squeeze = SPACE if spec["escape"] else " ", spec["squeeze"]
    while squeeze and i < len(data) and (first := step())[1] == " ":
        i += first[0]
    if i == len(data):
        return "", np.array([i], np.int64)
    if spec["dummy"]:
        out.append(space)
        at.append(i)
    after_space = squeeze
    while i < len(data):
        n, new = step()
        if after_space:
            new = new.lstrip(" ")
        out += new.replace(" ", space)
        at += [i] * len(new)
        after_space = squeeze and (new.endswith(" ") if new else after_space)
        i += n
    while squeeze and out and out[-1] == space:
        out.pop()
        at.pop()
    return "".join(out), np.array([*at, len(data)], np.int64)


# -- encoding -------------------------------------------------------------------------------------


class Encoder:
    def __init__(self, model: str | bytes):
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        self.spec = normalizer_of(model)
        self.charmap = CharMap(self.spec["charsmap"])
        #: The library without a normalisation of its own, for the merges; and as it is, for decoding.
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=with_normalizer(model, b"", False, False))
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(size)]
        self.is_byte = [self.sp.is_byte(i) for i in range(size)]
        own = [dict(_fields(v)) for k, v in _fields(model) if k == 1]
        symbols = sorted((p[1].decode() for p in own if p.get(3) == USER_DEFINED), key=len, reverse=True)
        self.symbols = re.compile("|".join(map(re.escape, symbols))) if symbols else None
        #: Characters of a piece, and source bytes if a U+2581 stands for a space. A byte piece has one byte.
        self.chars = [len(p) for p in pieces]
        self.bytes = [1 if b else len(p.replace(SPACE, " ").encode()) for p, b in zip(pieces, self.is_byte)]
        #: Every character has a piece or falls back to bytes, so ids tell their characters.
        self.falls_back = any(self.is_byte)
        normal = [p for p, q in zip(pieces, own) if q.get(3, 1) in (1, USER_DEFINED)]
        #: Whether pieces never cross from a character into a following U+2581 (spaces may follow each other).
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in normal)
        #: The character map is empty and spaces are only replaced: the longest prefix is always one character, as it is.
        self.plain = not self.spec["charsmap"] and self.spec["dummy"] and self.spec["escape"] and not self.spec["squeeze"] and self.falls_back and self.splits and not symbols
        self.known: dict[str, tuple] = {}

    def _spans(self, segment: str, ids: list[int]) -> list[tuple[int, int]]:
        """(character of the segment, byte in it) at which each piece begins."""
        if not self.falls_back:  # an unknown piece can hold several characters
            return [(p.begin, 0) for p in self.merges.encode(segment, out_type="immutable_proto", num_threads=1).pieces]
        out, char, byte = [], 0, 0
        for i in ids:
            out.append((char, byte))
            if self.is_byte[i]:  # one byte of a character that has no piece
                byte += 1
                if byte == len(segment[char].encode()):
                    char, byte = char + 1, 0
            else:
                char += self.chars[i]
        return out

    def _merge(self, segments: list[str]) -> None:
        """Remember of each normalised segment its ids and their source byte counts, as 32-bit bytes, the latter for plain models only."""
        new = [s for s in dict.fromkeys(segments) if s not in self.known]
        if len(self.known) + len(new) > CACHE_SEGMENTS:
            self.known = {}
            new = list(dict.fromkeys(segments))
        for s, ids in zip(new, self.merges.encode(new, num_threads=1)):
            self.known[s] = array("i", ids).tobytes(), array("i", [self.bytes[i] for i in ids]).tobytes()

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, np.ndarray]]:
        """Of each text (ids as 32-bit bytes, piece boundaries: for each piece its start, then the last
        one's end), boundaries in bytes of the original text."""
        plain = [bool(t) and self.plain and SPACE not in t for t in texts]
        aligned = [normalize(t, self.spec, self.charmap, self.symbols) if t and not p else ("", None) for t, p in zip(texts, plain)]
        normal = [SPACE + t.replace(" ", SPACE) if p else a for t, p, (a, _) in zip(texts, plain, aligned)]
        cut = [SEGMENT.findall(n) if self.splits else [n] * bool(n) for n in normal]
        get = self.known.get
        got = [list(map(get, c)) for c in cut]
        if missing := [s for c, g in zip(cut, got) if None in g for s, x in zip(c, g) if x is None]:
            was = self.known
            self._merge(missing if len(was) + len(missing) <= CACHE_SEGMENTS else [s for c in cut for s in c])
            get = self.known.__getitem__
            got = [list(map(get, c)) for c in cut]
        out = []
        for t, p, c, g, (_, at) in zip(texts, plain, cut, got, aligned):
            ids = b"".join([x[0] for x in g])
            if p:
                ends = np.zeros(len(lengths := np.frombuffer(b"".join([x[1] for x in g]), np.int32)) + 1, np.int64)
                np.cumsum(lengths, out=ends[1:])
                ends[1:] -= 1  # the marker put before the text has no byte there
            elif at is None:
                ends = np.zeros(1, np.int64)
            else:
                bounds, first = [], 0
                for s, (own, _) in zip(c, g):
                    for char, byte in self._spans(s, np.frombuffer(own, np.int32).tolist()):
                        start = int(at[first + char])
                        bounds.append(min(start + byte, max(start, int(at[first + char + 1]))))
                    first += len(s)
                ends = np.array([*bounds, len(t.encode())], np.int64)
                ends[0] = 0  # what is squeezed away at the front belongs to the first piece, at the back to the last
            out.append((ids, ends))
        return out


@lru_cache(maxsize=1)
def encoder_for(model_path: str | bytes) -> Encoder:
    """One for each Python worker, so that what it remembers serves all of the worker's tasks."""
    return Encoder(model_path)


def encode(docs: DataFrame, model_path: str | bytes, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids (array<int>; those of the model, a file or its content), starts and ends (array<long>): the pieces of each whole text and the
    bytes of the original text that each came from; decoded adds a column of that name, the text that the
    ids decode to, made in the same pass. Spans follow each other without gaps; the marker
    put before a text has no bytes of its own. A null or empty text has no pieces. Columns of docs with
    these names are replaced; repeated rows are encoded alike; an empty table gives no rows."""
    docs = docs.drop("ids", "starts", "ends", *["decoded"] * decoded)
    schema = docs.withColumn("ids", F.lit(None).cast("array<int>")).withColumn("starts", F.lit(None).cast("array<long>")).withColumn("ends", F.lit(None).cast("array<long>"))
    schema = (schema.withColumn("decoded", F.lit(None).cast("string")) if decoded else schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model_path)
        for whole in batches:
            where = whole.schema.get_field_index(text)
            i = 0
            while i < whole.num_rows:  # about 1 MB of text at a time
                n, size = 0, 0
                while i + n < whole.num_rows and size < 1_000_000:
                    size += len(whole.column(where)[i + n].as_buffer() or b"") if whole.column(where)[i + n].is_valid else 0
                    n += 1
                batch = whole.slice(i, n)
                i += n
                got = encoder.encode(batch.column(where).to_pylist())
                offsets = np.cumsum([0, *(len(b) // 4 for b, _ in got)]).astype(np.int32)
                lists = [np.frombuffer(b"".join(b for b, _ in got), np.int32), np.concatenate([e[:-1] for _, e in got]), np.concatenate([e[1:] for _, e in got])]
                arrays = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in lists]
                names = [*batch.schema.names, "ids", "starts", "ends"]
                if decoded:
                    arrays.append(pa.array([encoder.sp.decode(np.frombuffer(b, np.int32).tolist()) for b, _ in got], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return docs.mapInArrow(run, schema)


def decode(ids: Column, model_path: str) -> Column:
    """The text of an array of ids; null for null."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for s in batches:
            yield s.map(lambda x: None if x is None else sp.decode(x.tolist()))

    return of(ids)
