"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence s has a probability p_s = sigmoid(bias + the sum of
the weights of its words' features); a document is toxic if any of its sentences is, so its
probability is the noisy-or 1 - prod(1 - p_s). Weights are trained from document labels alone; the
same p_s then locate the offending sentences.

Features of a word: the word itself and its beginnings of 4, 5 and 6 characters, so that an
inflected or suffixed form of an offensive stem is found too. Only features seen in MIN_DOCS training documents
or more count.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .common import first_of_each, fresh

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")
#: Bounds of the training sample: toxic texts (clean ones: twice as many), and characters of all texts of a label.
SAMPLE_EACH, SAMPLE_CHARS = 1500, 24_000_000
MIN_DOCS, STEPS, RATE, EPSILON, SHRINK, BIAS = 5, 100, 0.3, 1e-4, 4e-3, -10.0
CACHE_WORDS = 200_000


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Character spans of the sentences of a text: runs up to . ! ? or a line's end."""
    return [m.span() for m in SENTENCE.finditer(text)]


def _bags(texts: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words; the word of each (sentence, word), where each sentence begins among these, and the document of each sentence.
    Sentences without words are left out."""
    word_id: dict[str, int] = {}
    number = word_id.setdefault
    words, starts, docs = array("i"), array("q"), array("i")
    for d, t in enumerate(texts):
        low = t.lower()
        for a, b in sentences(low):
            if own := set(WORD.findall(low, a, b)):
                starts.append(len(words))
                docs.append(d)
                words.extend([number(x, len(word_id)) for x in own])
    return word_id, np.array(words), np.array(starts), np.array(docs)


def train(texts: list[str], toxic: np.ndarray) -> dict[str, float]:
    """Weights by feature, and the fixed BIAS under "": full-batch Adam on the noisy-or log-likelihood,
    with shrinking so that what tells nothing weighs nothing. Two sparse steps make a sentence's
    sum: features to words, words to sentences. The bias is a prior, not trained: it is what keeps a document of
    very many unremarkable sentences clean."""
    word_id, in_word, starts, doc = _bags(texts)
    used, doc = np.unique(doc, return_inverse=True)  # documents with words
    y = toxic[used].astype(bool)
    if not len(used) or y.all() or not y.any():
        return {"": BIAS}
    feature_id: dict[str, int] = {}
    of_word, of_feature = [], []
    for x, i in word_id.items():
        own = [feature_id.setdefault(f, len(feature_id)) for f in features(x)]
        of_word += [i] * len(own)
        of_feature += own
    of_word, of_feature = np.array(of_word), np.array(of_feature)
    n, words, size = len(used), len(word_id), len(feature_id)
    in_sent = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(starts, append=len(in_word)))
    by_word = in_sent[np.argsort(in_word, kind="stable")]
    word_starts = np.concatenate([[0], np.cumsum(np.bincount(in_word, minlength=words))[:-1]])
    doc_starts = np.flatnonzero(np.diff(doc, prepend=-1))
    # documents that hold a feature's words, added over its words
    in_doc = doc[by_word].astype(np.int64)
    new = np.diff(in_doc, prepend=-1) != 0
    new[word_starts] = True
    docs_of = np.bincount(of_feature, np.add.reduceat(new.astype(np.int64), word_starts)[of_word], size)
    keep = docs_of[of_feature] >= MIN_DOCS
    of_word, of_feature = of_word[keep], of_feature[keep]
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    balance = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    for step in range(1, STEPS + 1):
        weight = np.bincount(of_word, w[of_feature], words).astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(BIAS + np.add.reduceat(weight[in_word], starts), -30, 30)))
        some = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-6)), doc_starts, dtype=np.float64))
        # d(log-likelihood)/da_s: toxic p_s (1 - P) / P, clean -p_s
        by_doc = np.where(y, balance * (1 - some) / np.maximum(some, 1e-9), -balance)
        g = np.bincount(of_feature, np.add.reduceat((by_doc[doc] * p).astype(np.float32)[by_word], word_starts)[of_word], size)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + EPSILON)
        w = np.sign(w) * np.maximum(np.abs(w) - SHRINK, 0)
    return {"": BIAS} | {f: float(w[i]) for f, i in feature_id.items() if w[i]}


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_each: int = SAMPLE_EACH, sample_chars: int = SAMPLE_CHARS) -> dict[str, float]:
    """Weights from a bounded sample of docs with labels (both by doc_id, and only rows that may be learned from): at most
    sample_each toxic and twice as many clean different texts, the first in the order of a hash of the text. Each teaches
    whole, whatever its length; if the drawn texts of a label exceed sample_chars characters together, the longest of them
    are left out until they don't (the shortest is always taken).

    Labelled documents are first brought to one hash for each different text, so copies count once and no texts but the sample's
    move; a text with both labels is toxic. Null texts, ids and labels teach nothing.
    """
    rows = labels.select(F.col(doc_id).alias("_id"), F.col(toxic).cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)")
    hashed = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_h"), F.length(text).alias("_n"))
    texts = hashed.join(rows.groupBy("_id").agg(F.max("_toxic").alias("_toxic")), "_id").groupBy("_h").agg(F.min("_id").alias("_id"), F.max("_toxic").alias("_toxic"), F.max("_n").alias("_n"))
    texts = materialize(texts)
    want = {k: (2 - k) * sample_each for k in (0, 1)}
    drawn = reduce(DataFrame.unionByName, [first_of_each(texts.where(F.col("_toxic") == k), "_toxic", "_h", n) for k, n in want.items()])
    upto = F.sum("_n").over(W.partitionBy("_toxic").orderBy("_n", "_h").rowsBetween(W.unboundedPreceding, 0))
    drawn = drawn.withColumn("_upto", upto).where((F.col("_upto") <= sample_chars) | (F.col("_upto") == F.col("_n")))
    drawn = materialize(drawn.drop("_n", "_upto"))  # at most 3 * sample_each ids
    got = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id").where(F.xxhash64("_text") == F.col("_h"))
    got = got.groupBy(F.col("_h").alias("h")).agg(F.min("_text").alias("text"), F.max("_toxic").alias("toxic")).orderBy("h").collect()
    return train([r["text"] for r in got], np.array([r["toxic"] for r in got], dtype=int))


class Scorer:
    """Scores texts; remembers the weights of words, at most CACHE_WORDS of them."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.bias, self.words = weights, weights.get("", BIAS), {}

    def of_sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        low = text.lower()
        text = low if len(low) == len(text) else text  # spans are those of the text itself
        spans, words, get = sentences(text), self.words, self.weights.get
        sums = []
        for a, b in spans:
            total = 0.0
            for x in set(WORD.findall(text, a, b)):
                s = words.get(x)
                if s is None:
                    if len(words) >= CACHE_WORDS:
                        words.clear()
                    s = words[x] = sum(get(f, 0.0) for f in features(x.lower()))
                total += s
            sums.append(total)
        return spans, 1 / (1 + np.exp(-np.clip(np.array(sums) + self.bias, -30, 30)))

    def of_text(self, text: str | None) -> float:
        if not text:
            return 0.0
        _, p = self.of_sentences(text)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def score(docs: DataFrame, weights: dict[str, float], text: str = "text") -> DataFrame:
    """docs with the column score: the probability (0 to 1) that the text is toxic.

    Null, empty and blank texts score 0. Whole texts are read. A column of docs called score is
    replaced, all others stay; repeated rows score alike; an empty table gives no rows."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the training sample

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for s in batches:
            yield pd.Series([scorer.of_text(t) for t in s], dtype="float64")

    return docs.withColumn("score", of(F.col(text)))


def locate(docs: DataFrame, weights: dict[str, float], text: str = "text", least: float = 0.5) -> DataFrame:
    """One row for each offending sentence: docs' columns but the text, and sentence, start, end
    (characters) and sentence_score, for sentences with a probability of least or more. Null, empty and clean texts
    give no rows; columns with these names are replaced, others stay; repeated rows give their rows again."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<struct<sentence:string,start:long,end:long,sentence_score:double>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for s in batches:
            out = []
            for t in s:
                spans, p = scorer.of_sentences(t) if t else ([], [])
                out.append([{"sentence": t[a:b].strip(), "start": a, "end": b, "sentence_score": float(x)} for (a, b), x in zip(spans, p) if x >= least])
            yield pd.Series(out)

    kept = [c for c in docs.columns if c not in (text, "sentence", "start", "end", "sentence_score")]
    each = fresh(docs, "s")[0]
    return docs.select(*kept, F.explode(found(F.col(text))).alias(each)).select(*kept, f"{each}.*")
