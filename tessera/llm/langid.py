"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows of WINDOW bytes, once forwards and once
backwards, labels every byte position with probabilities over the languages, and the mean over
all positions of a document is its prediction. It is trained in numpy by backpropagation through
time on a bounded sample of labelled rows; scoring runs in Spark tasks, window batch by window
batch, so memory doesn't depend on a text's length.

The cell is the minimal gated unit: one gate resets and updates the state. Gates use the hard sigmoid
and states the softsign, both cheap and with simple derivatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .common import first_of_each, fresh

HIDDEN, WINDOW, BATCH = 6, 128, 2048
#: Bounds of the training sample: rows, characters of them all, and languages.
SAMPLE_ROWS, SAMPLE_CHARS, MOST_LANGS = 3000, 24_000_000, 1000
STEPS, TRAIN_BATCH, SEED = 200, 160, 7
UNDETERMINED = "und"


def _inputs(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What each byte adds to gate and candidate: (2 hidden, time, batch)."""
    at = x.astype(np.intp)
    out = np.empty((table.shape[1], *x.shape), np.float32)
    for j, column in enumerate(np.ascontiguousarray(table.T)):
        np.take(column, at, out=out[j], mode="clip")
    return out


def _run(x: np.ndarray, w: dict, side: str, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (time, hidden, batch) of one direction; x: byte ids (time, batch).

    gate f = clip((in + U h) / 4 + 1/2, 0, 1); candidate c = softsign(in + f * (U h));
    h = h + f * (c - h): one gate both resets and updates.
    """
    steps, batch = x.shape
    u = np.ascontiguousarray(w[f"u{side}"].T)
    n = u.shape[1]
    a = _inputs(x, w[f"x{side}"])
    h = np.zeros((n, batch), np.float32)
    out = np.empty((steps, n, batch), np.float32)
    quarter, half, one, zero = map(np.float32, (0.25, 0.5, 1, 0))
    tape = []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        b = u @ h
        f = b[:n]
        f += a[:n, t]
        f *= quarter
        f += half
        np.maximum(f, zero, out=f)
        np.minimum(f, one, out=f)
        c = b[n:] * f
        c += a[n:, t]
        d = np.abs(c)
        d += one
        c /= d
        if keep:
            tape.append((t, h, b[n:], f, c.copy(), d))
        c -= h
        c *= f
        h = np.add(h, c, out=out[t])
    return out, tape


def _labels(hf: np.ndarray, hb: np.ndarray, w: dict) -> np.ndarray:
    """Probabilities (time, languages, batch) over the languages at every position."""
    p = w["of"].T @ hf
    p += w["ob"].T @ hb
    p += w["bias"][:, None]
    np.minimum(p, np.float32(80), out=p)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True) + np.float32(1e-30)
    return p


def _back(x: np.ndarray, tape: list, dh_out: np.ndarray, w: dict, side: str, grad: dict) -> None:
    """Backpropagation through time of one direction; adds to grad."""
    u = w[f"u{side}"]
    n = u.shape[0]
    gu = np.zeros_like(u)
    into = np.empty((x.shape[0], 2 * n, x.shape[1]), np.float32)
    carry = np.zeros_like(dh_out[0])
    for t, h, bc, f, c, d in reversed(tape):
        dh = dh_out[t] + carry
        dc = dh * f / (d * d)
        df = (dh * (c - h) + dc * bc) * ((f > 0) & (f < 1)) * np.float32(0.25)
        into[t, :n], into[t, n:] = df, dc
        db = np.concatenate([df, dc * f])
        gu += h @ db.T
        carry = dh * (1 - f) + u @ db
    grad[f"u{side}"] = gu
    flat = x.ravel()
    grad[f"x{side}"] = np.stack([np.bincount(flat, into[:, j].ravel(), 256) for j in range(2 * n)], 1)


def train(windows: np.ndarray, langs: np.ndarray, classes: int, steps: int = STEPS, seed: int = SEED) -> dict:
    """Weights, from byte windows (n, WINDOW) and class numbers (n,), by Adam on the mean
    cross-entropy of all positions."""
    rng = np.random.default_rng(seed)
    n = HIDDEN
    w = {"bias": np.zeros(classes)}
    for side in "fb":
        w[f"x{side}"] = rng.normal(0, 0.5, (256, 2 * n))
        w[f"u{side}"] = rng.normal(0, 0.35, (n, 2 * n))
        w[f"o{side}"] = rng.normal(0, 0.35, (n, classes))
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    by_class = [i for k in range(classes) if len(i := np.flatnonzero(langs == k))]
    each = max(1, TRAIN_BATCH // classes)
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(i, each) for i in by_class])
        x, y = np.ascontiguousarray(windows[pick].T), langs[pick]
        (hf, tf), (hb, tb) = _run(x, w, "f", True), _run(x, w, "b", True)
        p = _labels(hf, hb, w)
        p[:, y, np.arange(len(y))] -= 1
        p /= p.shape[0] * p.shape[2]
        grad = {"bias": p.sum((0, 2)), "of": np.einsum("thb,tcb->hc", hf, p, optimize=True), "ob": np.einsum("thb,tcb->hc", hb, p, optimize=True)}
        _back(x, tf, w["of"] @ p, w, "f", grad)
        _back(x, tb, w["ob"] @ p, w, "b", grad)
        rate = 0.03 * (1 - step / (steps + 1)) + 1e-4
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def _windows(data: bytes) -> np.ndarray:
    """All of a text in rows of WINDOW bytes; the last row is padded with spaces."""
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(rows * WINDOW), np.uint8).reshape(rows, WINDOW)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, most_langs: int = MOST_LANGS) -> dict:
    """A model from labelled rows: {"langs": [...], "weights": {...}}.

    docs holds only rows that may be learned from. A bounded sample teaches: of every language the same number of
    different texts, together sample_rows (one of each language if there are more languages than that), the first in the order of a
    hash of the text. Each teaches whole, by all its windows of WINDOW bytes (those without a letter left out if others have
    one); if the drawn texts exceed sample_chars characters together, each language has an equal share of these, and its longest
    texts are left out until they fit (the shortest is always taken). The most_langs languages with most different texts are learned, ties by name. Rows with a null
    language or a text without letters teach nothing; with no rows left the model knows no language and predicts "und".
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    texts = materialize(rows.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n")))  # copies are one text
    known = materialize(texts.groupBy("lang").agg(F.count("*").alias("texts")).orderBy(F.desc("texts"), "lang").limit(most_langs).select("lang"))
    n = known.count()
    if not n:
        return {"langs": [], "weights": {}}
    drawn = first_of_each(texts.join(F.broadcast(known), "lang", "left_semi"), "lang", "h", max(1, sample_rows // n))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("n", "h").rowsBetween(W.unboundedPreceding, 0))
    drawn = drawn.withColumn("upto", upto).where((F.col("upto") <= sample_chars // n) | (F.col("upto") == F.col("n"))).select("lang", "h")
    drawn = materialize(drawn)  # at most sample_rows or n rows
    some = rows.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect()
    langs = sorted({r["lang"] for r in some})
    number = {name: k for k, name in enumerate(langs)}
    windows, labels = [], []
    for r in some:
        own = _windows(r["text"].encode())
        lettered = [any(map(str.isalpha, w.tobytes().decode(errors="ignore"))) for w in own]
        windows.append(own[lettered] if any(lettered) else own)
        labels.append(np.full(len(windows[-1]), number[r["lang"]]))
    return {"langs": langs, "weights": train(np.concatenate(windows), np.concatenate(labels), len(langs))}


def label_positions(data: bytes, model: dict) -> np.ndarray:
    """(bytes, languages): the probabilities of every byte position of one text."""
    x = np.ascontiguousarray(_windows(data).T)
    p = _labels(_run(x, model["weights"], "f")[0], _run(x, model["weights"], "b")[0], model["weights"])
    return p.transpose(2, 0, 1).reshape(-1, p.shape[1])[: len(data)]


def _pooled(texts: list[bytes], model: dict) -> np.ndarray:
    """Mean probabilities of each text over all its positions, in batches of BATCH windows."""
    lengths = np.array([len(t) for t in texts])
    rows = np.maximum(1, -(-lengths // WINDOW))
    doc = np.repeat(np.arange(len(texts)), rows)
    first = np.cumsum(rows) - rows
    left = np.minimum(lengths[doc] - (np.arange(len(doc)) - first[doc]) * WINDOW, WINDOW)
    total = np.zeros((len(texts), len(model["langs"])))
    x = np.frombuffer(b"".join(t.ljust(int(r) * WINDOW) for t, r in zip(texts, rows)), np.uint8).reshape(-1, WINDOW)
    at = np.arange(WINDOW)[:, None]
    for i in range(0, len(x), BATCH):
        part = np.ascontiguousarray(x[i : i + BATCH].T)
        p = _labels(_run(part, model["weights"], "f")[0], _run(part, model["weights"], "b")[0], model["weights"])
        n = left[i : i + BATCH]
        if n.min() < WINDOW:
            p *= (at < n)[:, None, :]
        np.add.at(total, doc[i : i + BATCH], p.sum(0, dtype=np.float64).T)
    return total / np.maximum(lengths, 1)[:, None]


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the pooled probability of lang_pred, 0 to 1).

    Each byte of a text is labelled, in windows of WINDOW bytes. A null text, a text without letters, and any text under a model without languages get "und"
    and score 0. Columns of docs called lang_pred or score are replaced; all others stay. Every
    byte of a text is read; repeated rows are scored alike; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB, whatever the corpus
    names = model["langs"]

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            pred, score = np.full(len(s), UNDETERMINED, object), np.zeros(len(s))
            use = [i for i, t in enumerate(s) if t is not None and names and any(map(str.isalpha, t))]
            start, size = 0, 0
            for k, i in enumerate(use):  # groups of about 2 MB of text
                size += len(s.iat[i])
                if size > 2_000_000 or k + 1 == len(use):
                    group = use[start : k + 1]
                    p = _pooled([s.iat[j].encode() for j in group], shared.value)
                    best = p.argmax(1)
                    pred[group] = [names[b] for b in best]
                    score[group] = np.clip(p[np.arange(len(group)), best], 0, 1)
                    start, size = k + 1, 0
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    found = fresh(docs, "label")[0]
    return docs.withColumn(found, label(F.col(text))).select(*docs.columns, f"{found}.lang_pred", f"{found}.score")
