"""Importance resampling, centroid clustering and mixing against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, common, importance, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rank string, taken string, weight string"
ODD = [None, "", " ", "Ünï Ünï a", "A b-c_d\x00e", "日本 語", "x" * 70000, "word " * 30000, "\n\n\n", "1 2 3 !!"]


def docs_of(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, "en", s, 0, "clash", "clash", "clash", "clash") for i, t, s in rows], DOCS)


# -- 11 -------------------------------------------------------------------------------------------


def features(text, longest=1):
    words = [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    return words, [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def resampled(rows, target, percent=10, least=20, longest=1, buckets=10000):
    s, t = Counter(), Counter()
    for texts, counts in (([t for _, t, _ in rows], s), (target, t)):
        for text in texts:
            counts.update(zlib.crc32(f) % buckets for f in features(text, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((float(t[b] + 1) * (S + buckets)) / (float(s[b] + 1) * (T + buckets))))
    out, keys = [], []
    for i, text, _ in rows:
        words, own = features(text, longest)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None])
        if len(words) >= least:
            keys.append(((-score, i is None, i or 0, len(own)), len(out) - 1))
    for place, (_, at) in enumerate(sorted(keys)[: percent * len(keys) // 100]):
        out[at][4] = place + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("longest, least, percent", [(1, 20, 10), (3, 2, 50), (1, 0, 100)])
def test_resampling_equals_plain_python(spark, longest, least, percent):
    rng = np.random.default_rng(3)
    vocabulary = "alpha Beta gamma DELTA one two 3 vier fünf x".split()
    rows = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 60))), "s") for i in range(200)]
    rows += [(1000 + i, t, "s") for i, t in enumerate(ODD)] + [(None, "alpha " * 25, "s"), (None, "alpha " * 25, "s"), (7, rows[7][1], "s"), (7, rows[7][1], None)]
    target = ["alpha two Two", None, "", "fünf-fünf"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs_of(spark, rows), bench, longest=longest, least_words=least, percent=percent)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == resampled(rows, target, percent, least, longest)


def test_resampling_of_nothing(spark):
    empty, bench = docs_of(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(empty, bench).collect() == []
    rows = [(1, "a " * 30, "s"), (2, None, "s")]
    assert sorted(tuple(r) for r in importance.resample(docs_of(spark, rows), bench, percent=50).select("doc_id", "rank").collect()) == [(1, None), (2, None)]


@pytest.mark.parametrize("parts", [1, 7])
def test_cutoff_is_the_kth_key_in_few_rounds(spark, parts, monkeypatch):
    rng = np.random.default_rng(parts)
    rows = [(int(a), int(b), 0, i) for i, (a, b) in enumerate(zip(rng.integers(-5, 5, 3000), rng.integers(0, 9, 3000)))]
    keys = spark.createDataFrame(rows, "a long, b long, c long, rid long").repartition(parts, "a")  # by value: partitions are unlike each other
    rounds, sides = [], importance._sides
    monkeypatch.setattr(importance, "_sides", lambda p: rounds.append(p) or sides(p))
    rows.sort()
    for k in (1, 2, 1500, 2999, 3000):
        rounds.clear()
        assert importance.cutoff(keys, k) == rows[k - 1]
        assert len(rounds) <= 2 + math.log(3000) / math.log(4 / 3)
    assert importance.cutoff(keys, 0) is None and importance.cutoff(keys, 3001) is None


def test_weighted_median_leaves_a_quarter_on_either_side():
    rng = np.random.default_rng(0)
    for _ in range(50):
        parts = [np.sort(rng.integers(0, 1000, rng.integers(1, 80)) * 1000 + i) for i in range(rng.integers(1, 12))]
        pivot = importance._weighted_median([(len(p), (int(p[(len(p) - 1) // 2]),)) for p in parts])[0]
        every = np.concatenate(parts)
        assert (every <= pivot).sum() >= len(every) / 4 and (every >= pivot).sum() >= len(every) / 4


def test_places_are_gapless(spark):
    rows = [(i % 7, i % 3) for i in range(100)] + [(None, 1)]
    got = common.placed(spark.createDataFrame(rows, "at int, part int"), [F.col("at").asc_nulls_last(), F.col("part")], "place").collect()
    assert [(r["at"], r["part"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert sorted(r["place"] for r in got) == list(range(1, 102))


# -- 12 -------------------------------------------------------------------------------------------


def clustered(rows, dim, scale, clusters, rounds):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    centers = [v for _, _, v in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v, v) for i, v in kept)][:clusters]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centers = [[sum(x) // len(own[k]) for x in zip(*own[k])] if own[k] else c for k, c in enumerate(centers)]
    got = [(i, *reversed(near(v))) for i, v in kept]
    sums = Counter()
    for _, k, d in got:
        sums[k] += d
    return sorted(((i, k, d, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest()) for i, k, d in got), key=repr)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, vec string, distance string")


OUT = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("dim, clusters, rounds, spread", [(4, 6, 5, 3.0), (64, 40, 5, 1.0), (3, 50, 2, 0.01), (4, 5, 5, 2e5)])
def test_clusters_equal_plain_python(spark, dim, clusters, rounds, spread):
    rng = np.random.default_rng(dim)
    x = (rng.normal(size=(150, dim)) * spread).astype(np.float32)
    x[5:40] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(150)] + [(7, [float(v) for v in x[9]]), (7, [float(v) for v in x[9]]), (None, [0.0] * dim), (200, [-0.0] * dim)]
    rows += [(201, None), (202, []), (203, [1.0] * (dim + 1)), (204, [None] * dim), (205, [float("nan")] * dim), (206, [float("-inf")] * dim)]
    got = centroids.cluster(vectors_of(spark, rows), dim=dim, clusters=clusters, rounds=rounds)
    assert sorted((tuple(r) for r in got.select(*OUT).collect()), key=repr) == clustered(rows, dim, 256, clusters, rounds)


def test_clusters_of_few_and_of_none(spark):
    assert centroids.cluster(vectors_of(spark, []), dim=2).collect() == []
    rows = [(1, [1.0, 2.0]), (2, [3.0, -0.5])]
    got = centroids.cluster(vectors_of(spark, rows), dim=2)
    assert sorted((tuple(r) for r in got.select(*OUT).collect()), key=repr) == clustered(rows, 2, 256, 40, 5)


def test_vectors_beyond_whole_numbers_move_nothing(spark):
    rows = [(i, [float(i), -float(i)]) for i in range(30)]
    got = {r["vec_id"]: r for r in centroids.cluster(vectors_of(spark, [*rows, (99, [1e30, 0.0])]), dim=2, clusters=4).collect()}
    assert got[99]["cluster"] is None and got[99]["distance"] is None
    assert sorted((tuple(got[i][c] for c in OUT) for i in range(30)), key=repr) == clustered(rows, 2, 256, 4, 5)
    wide = [(0, [1e13, 0.0]), (1, [-1e13, 0.0]), (2, [0.0, 0.0])]  # whole numbers, distances beyond 64 bits
    got = centroids.cluster(vectors_of(spark, wide), dim=2, clusters=1).collect()
    assert {r["vec_id"]: r["distance"] for r in got if r["vec_id"] < 2} == {0: None, 1: None} and {r["inertia"] for r in got} == {None}


# -- 13 -------------------------------------------------------------------------------------------


def wanted(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by the rule: share out by weight, stop what is above, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in above}
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def mixed(docs, rows):
    got = [tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()]
    source = {i: s for i, _, s in rows}
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^ \t-\r]+", t or ""))
    assert sorted((i, n) for i, n, *_ in got) == sorted((i, len(re.findall(r"[^ \t-\r]+", t or ""))) for i, t, _ in rows)
    for i, n, whole, target, k in got:
        assert 0 <= k <= 2 * n and whole == sizes[source[i]]
        assert target == pytest.approx(wanted(sizes)[source[i]])
        taken[source[i]] += k
    return got, taken, {s: wanted(sizes)[s] for s in sizes}


@pytest.mark.parametrize("block", [20_000, 16])
def test_mix_meets_every_target(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(n), "abcdefghij"[int(k)]) for i, (n, k) in enumerate(zip(rng.geometric(0.02, 900), rng.choice(10, 900, p=[0.35] + [0.65 / 9] * 9)))]
    rows += [(2000 + i, t, s) for i, (t, s) in enumerate(zip(ODD, [None, "", "a", None, "z", "ü", "z", "日本", None, "only"]))]
    got, taken, target = mixed(docs_of(spark, rows), rows)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    # nearly all documents are taken whole, as often as the rate says, rounded
    whole = sum(k in (n * math.floor(t / w), n * math.ceil(t / w)) for _, n, w, t, k in got if w)
    assert whole >= len(got) - 2 * len(target)
    again = [tuple(r) for r in mixing.mix(docs_of(spark, rows[::-1]).repartition(5)).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(again) == sorted(got)


def test_mix_balances_documents_and_keeps_the_odds():
    rng = np.random.default_rng(2)
    sizes, chances = rng.geometric(0.01, 400), np.full(400, 0.3)
    sums = []
    for seed in range(200):
        p = mixing.fly(sizes, chances, [seed])
        assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
        assert abs(p.sum() - 120) < 1e-6 and abs((p * sizes).sum() - 0.3 * sizes.sum()) < 1e-4
        sums.append(p)
    assert abs(mean(np.mean(sums, axis=0)) - 0.3) < 1e-6 and np.abs(np.mean(sums, axis=0) - 0.3).max() < 0.15  # five standard errors
    assert ((p := mixing.fly(np.full(9, 5), np.full(9, 1 / 3), [0])) > 1 - 1e-9).sum() == 3 and ((p > 1e-9) & (p < 1 - 1e-9)).sum() == 0


def test_mix_of_repeated_rows_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 10)
    rows = [(1, "one two three", "a")] * 64 + [(2, "four", "a"), (None, "five six", None), (None, None, None), (3, "", "b"), (4, None, "b")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes = {"a": 193, None: 2, "b": 0}
    for s, one in (("a", 193), (None, 2)):
        own = [r for r in got if r["source_size"] == one]
        assert abs(sum(r["taken"] for r in own) - wanted(sizes)[s]) <= 1
    assert mixing.mix(docs_of(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(docs_of(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 1, "e": 4000, None: 300}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(wanted(sizes))
