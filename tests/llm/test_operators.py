"""Each operator against a brute-force version, an exact round trip, or held-out accuracy."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ann, blocks, chat, common, langid, linededup, packing, pieces, queries, sharding, simhash, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string"
WORDS = "alpha beta gamma delta one two three four five six seven eight nine ten".split()


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", 0 if t is None else len(t), "clash", "clash") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "one", "one", "a b c d e f", "a b c d e f", "ÄÖ ß <|end|> 日本", "x" * 70000, "\n\n\n", "1 2 3 !!"]


# -- 1 and 8 --------------------------------------------------------------------------------------


def embeddings(spark, n=900, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[5:9] = x[0]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    rows += [(n, None, 0), (n + 20, [float("nan")] * dim, 0), (n + 40, [0.0] * dim, 0), (n + 60, [None] * dim, 0), (n + 80, [float("inf")] * dim, 0), (n + 100, [], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), x.astype(np.float64)


def brute(x, k):
    out = {}
    for q in range(0, len(x), 20):
        s = x @ x[q]
        out[q] = sorted(((-s[i], i) for i in range(len(x)) if i != q))[:k]
    return out


def test_ann_recall_and_scores(spark):
    df, x = embeddings(spark)
    got = defaultdict(list)
    for r in ann.search(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute(x, 20)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {v for _, v, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert all(abs(s - x[q] @ x[v]) < 1e-9 for _, v, s in rows)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)


def test_ann_scores_a_share_of_the_rows(spark):
    """On vectors without clusters: at most 45 % of any block for any query, with a recall of 0.9."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.where(blocks.usable(F.col("embedding"))).select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = ann.search(df).collect()
    assert max(r["scored"] / r["block_rows"] for r in got) <= 0.45
    found, hits = defaultdict(set), 0
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
    for q in found:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        hits += len(found[q] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert set(found) == {int(i) for i in ids if i % 20 == 0} and hits >= 0.9 * 20 * len(found)


def test_rows_of_one_id_are_queries_of_their_own(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.search(df).collect())
    assert got == sorted([(1, 1, 2.0), (2, 2, 1.0), (3, 20, 0.0), (1, 2, 3.0), (2, 1, 1.0), (3, 20, 0.0)])


def test_one_large_row_stops_no_search(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.integers(-6, 7, 5)]) for i in range(60)] + [(61, [2e9, 0.0, 0.0, 0.0, 0.0])]
    x = np.array([v for _, v in rows])
    got = defaultdict(list)
    for r in sorted(topk.top_k(spark.createDataFrame(rows, "vec_id long, vec array<double>")).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for q in (0, 20, 40):
        assert got[q] == sorted(((int(x[i] @ x[q]), rows[i][0]) for i in range(61) if i != q), key=lambda t: (-t[0], t[1]))[:20]


def test_ann_few_rows_and_empty(spark):
    df, _ = embeddings(spark, 12)
    got = ann.search(df).collect()
    assert {r["query_id"] for r in got} == {0} and len(got) == 11
    assert ann.search(df.limit(0)).collect() == []


def test_vectors_of_mixed_lengths_many_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 40)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 6)) * 8)
    x[:, 4:][rng.random(300) < 0.5] = 0
    rows = [(i, [float(v) for v in (x[i][:4] if not x[i][4:].any() else x[i])], "a", "b") for i in range(300)]
    rows += [(None, [1.0] * 6, "a", "b"), (400, [], "a", "b"), (7, rows[7][1], "a", "b")]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>, score string, id string")
    ids, full = [*range(300), 400, 7], np.vstack([x, np.zeros(6), x[7]])
    search = topk.Search(df, 5, "vec_id", "vec", 2, 20)
    assert search.rows.blocks > 5 and search.rows.dim == 6
    cutoffs = search.first_cutoff()
    moved = search.collected(cutoffs).select(F.sum(F.size("rids"))).first()[0]
    assert cutoffs.count() == 16 and moved < 0.5 * 2 * 16 * 302
    got, near = defaultdict(list), defaultdict(set)
    for r in topk.top_k(df, 5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for r in ann.search(df, 5, vec="vec").collect():
        near[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in [*range(0, 300, 20), 400]:
        s = full @ full[ids.index(q)]
        want = sorted((-int(s[i]), v) for i, v in enumerate(ids) if v != q)[:5]
        assert [(-s, v) for _, v, s in sorted(got[q])] == want
        hits += len({v for _, v in want} & near.get(q, set())) if q != 400 else 0  # a zero vector takes no part
    assert 400 not in near and hits >= 0.9 * 75
    with pytest.raises(ArithmeticError):
        topk.top_k(spark.createDataFrame([(0, [9e15]), (1, [9e15])], "vec_id long, vec array<double>"))
    huge = topk.top_k(spark.createDataFrame([(0, [3e8, 1.0]), (1, [3e8, -1.0])], "vec_id long, vec array<double>")).collect()
    assert [r["score"] for r in huge] == [9 * 10**16 - 1]


def test_topk_rows_of_one_id_are_queries_of_their_own(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])], "vec_id long, vec array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    assert got == sorted([(1, 1, 2), (2, 2, 1), (3, 20, 0), (1, 2, 3), (2, 1, 1), (3, 20, 0)])


@pytest.mark.parametrize("k", [3, 20])
def test_topk_is_exact_where_bounds_and_parts_pass_64_bits(spark, k):
    rng = np.random.default_rng(2)
    small = rng.integers(-6, 7, (200, 4)).astype(float)
    rows = [[float(v) for v in r] for r in small]
    # products of the outliers are huge in either slice and small in sum; query 40 is large itself, but not along most rows
    rows[3], rows[4], rows[7] = [2.0**70, 1.0, -(2.0**70), 5.0], [2.0**60, 0.0, -(2.0**60), 9.0], [-(2.0**80), 0.0, 2.0**80, 4.0]
    for q in range(0, 200, 20):
        rows[q][2] = rows[q][0]
    rows[40] = [2.0**52, 3.0, 2.0**52, 1.0]
    whole = [[int(v) for v in r] for r in rows]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(list(enumerate(rows)), "vec_id long, vec array<double>"), k).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 200, 20):
        want = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(200) if i != q)[:k]
        assert [(-s, v) for _, v, s in sorted(got[q])] == want


def test_forest_descends_to_longest_prefixes():
    x = np.random.default_rng(3).normal(size=(500, 16)).astype(np.float32)
    f = ann.Forest(x, 5, 3)
    codes = ann._as_numbers(ann.strings(x[:7], 5, 3))
    lo, hi = f.ranges(codes)
    whole = ann.strings(x, 5, 3)
    for d in range(4):
        for t in range(5):
            for q in range(7):
                same = np.flatnonzero((whole[t, :, :d] == whole[t, q, :d]).all(1))
                assert set(f.order[t, lo[d, t, q] : hi[d, t, q]]) == set(same)


def test_topk_exact(spark):
    df, x = embeddings(spark, 700, 10, 4)
    df = df.withColumn("vec", F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), v).otherwise(F.floor(v * 64).cast("double"))))
    whole = np.vstack([np.floor(64 * x)])
    got = defaultdict(list)
    for r in topk.top_k(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids = list(range(700)) + [740]
    whole = np.vstack([whole, np.zeros(10)])
    for q in [*range(0, 700, 20), 740]:
        s = whole @ whole[ids.index(q)]
        want = sorted(((-int(s[i]), v) for i, v in enumerate(ids) if v != q))[:20]
        assert [(-s, v) for _, v, s in sorted(got[q])] == want
    assert topk.top_k(df.limit(0)).collect() == []
    few = topk.top_k(df.where("vec_id < 5")).collect()
    assert len(few) == 4


# -- 2 and 10 -------------------------------------------------------------------------------------


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 4)), np.array([0, 1, 1, 0])
    n = langid.HIDDEN
    w = {"bias": np.zeros(2)} | {f"x{s}": rng.normal(0, 0.5, (256, 2 * n)) for s in "fb"} | {f"u{s}": rng.normal(0, 0.3, (n, 2 * n)) for s in "fb"} | {f"o{s}": rng.normal(0, 0.3, (n, 2)) for s in "fb"}
    w = {k: v.astype(np.float32) for k, v in w.items()}

    def loss(w):
        p = langid._labels(langid._run(x, w, "f")[0], langid._run(x, w, "b")[0], w)
        return -np.log(p[:, y, np.arange(4)]).mean()

    (hf, tf), (hb, _) = langid._run(x, w, "f", True), langid._run(x, w, "b", True)
    p = langid._labels(hf, hb, w)
    p[:, y, np.arange(4)] -= 1
    p /= p.shape[0] * p.shape[2]
    grad = {}
    langid._back(x, tf, w["of"] @ p, w, "f", grad)
    for key, at in (("uf", (1, 2)), ("uf", (3, n + 1)), ("xf", (int(x[2, 1]), n + 2)), ("xf", (int(x[0, 0]), 1))):
        eps, num = 1e-2, []
        for sign in (1, -1):
            v = {k: a.copy() for k, a in w.items()}
            v[key][at] += sign * eps
            num.append(loss(v))
        assert grad[key][at] == pytest.approx((num[0] - num[1]) / (2 * eps), rel=0.1, abs=2e-4)


def test_langid_held_out_accuracy(spark):
    got = queries.op2_langid(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) > 0.97


def test_langid_odd_rows(spark):
    df = docs_of(spark, ODD)
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert len(got) == len(ODD) and got[0]["lang_pred"] == got[1]["lang_pred"] == got[10]["lang_pred"] == "und"
    assert got[3]["lang_pred"] == "en" and got[3]["score"] == got[4]["score"] and 0 <= got[8]["score"] <= 1
    assert langid.label_positions("één".encode(), model).shape == (5, 1)
    assert langid.predict(df.limit(0), model).collect() == []
    assert {r["lang_pred"] for r in langid.predict(df, langid.fit(df.limit(0))).collect()} == {"und"}


def test_langid_learns_all_languages_from_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "train", lambda windows, langs, classes: (windows, langs))
    many = spark.createDataFrame([(i, f"wort {i}", f"l{i % 201:03}") for i in range(1000)], "doc_id long, text string, lang string")
    model = langid.fit(many, sample_rows=40)
    assert model["langs"] == [f"l{i:03}" for i in range(201)] and len(model["weights"][1]) == 201
    late = spark.createDataFrame([(i, f"{i} 12 34 " * 1500 + f"erst hier steht etwas {i} " * 200, "de") for i in range(20)], "doc_id long, text string, lang string")
    windows = langid.fit(late)["weights"][0]
    assert len(windows) >= 20 and all(b"steht" in bytes(w) or b"hier" in bytes(w) or b"etwas" in bytes(w) for w in windows)


def test_langid_of_repeated_rows(spark):
    rows = [("immer derselbe Text", "de")] * 2000 + [(f"always another text {i}", "en") for i in range(50)]
    df = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, label string")
    for n in (20, 40, 100):
        model = langid.fit(df, sample_rows=n)
        assert model["langs"] == ["de", "en"]
    out = langid.predict(df, model)
    assert out.columns == [*df.columns, "lang_pred", "score"] and out.select("lang_pred").distinct().count() == 2 and out.where("label = 'x'").count() == 2050


def test_langid_against_plain_python(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    model = langid.fit(df)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in langid.predict(df, model).collect():
        p = langid.label_positions(texts[r["doc_id"]].encode(), model).mean(0)
        assert r["lang_pred"] == model["langs"][p.argmax()] and r["score"] == pytest.approx(p.max(), abs=1e-4)


def test_toxicity_learns_from_long_documents(spark):
    filler = [f"Sentence {i} of the page is nothing special." for i in range(900)]
    rows = [(i, " ".join(filler[i % 7 :]) + (" You grobble fool." if i % 2 else ""), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    s = toxicity.Scorer(weights)
    assert s.of_text("Good day. You grobble fool.") > 0.7 and s.of_text(rows[0][1]) < 0.3
    few = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), sample_chars=10)  # one text of each label
    assert few[""] == toxicity.BIAS


def test_a_very_long_clean_text_stays_clean(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    s = toxicity.Scorer(toxicity.fit(docs, labels))
    clean = [r["text"] for r in docs.join(labels.where("toxic = 0"), "doc_id").orderBy("doc_id").limit(400).collect()]
    clean = [t for t in clean if s.of_text(t) < 0.02]
    assert len(clean) > 300 and s.of_text("\n".join(clean)) < toxicity_bound(len(clean))


def toxicity_bound(n):
    """What n texts of 0.02 each make together, at most."""
    return 1 - 0.98**n


def test_toxicity_against_plain_python(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    weights = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, weights).collect():
        clean = 1.0
        for a, b in toxicity.sentences(texts[r["doc_id"]].lower()):
            words = set(toxicity.WORD.findall(texts[r["doc_id"]].lower()[a:b]))
            z = toxicity.BIAS + sum(weights.get(f, 0.0) for w in words for f in toxicity.features(w))
            clean *= 1 - 1 / (1 + np.exp(-z))
        assert r["score"] == pytest.approx(1 - clean, abs=1e-6)


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, "/root/testdata/sf0.1").where("held_out").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    both = [(got[d]["predicted"], t) for d, t in labels.items() if d in got]
    assert np.mean([p == t for p, t in both]) > 0.94
    assert np.mean([p for p, t in both if t]) > 0.7


def test_toxicity_parts_and_odd_rows(spark):
    texts = ["Good day. A fine thing here. Bye now"] * 40 + ["Good day. You grobble fool. Bye now"] * 40
    weights = toxicity.train(texts, np.array([0] * 40 + [1] * 40))
    s = toxicity.Scorer(weights)
    _, p = s.of_sentences("Good day. You grobble fool. Bye now")
    assert p[1] > 0.5 > max(p[0], p[2]) and s.of_text(texts[-1]) == pytest.approx(1 - np.prod(1 - p))
    df = docs_of(spark, [*ODD, texts[-1]])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, weights).collect()}
    assert got[0] == got[1] == 0 and got[11] > 0.5 and all(0 <= v <= 1 for v in got.values())
    found = toxicity.locate(df, weights).collect()
    assert [(r["doc_id"], r["sentence"], r["start"], r["end"]) for r in found] == [(11, "You grobble fool.", 9, 27)]
    assert toxicity.train([], np.array([])) == {"": toxicity.BIAS}


# -- 3 --------------------------------------------------------------------------------------------


def naive_print(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def naive_components(prints, bits=3):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_golay_keys_reach_every_pair():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    sides = []
    for fp in (a, b):
        key, at, side = simhash.keys_of(fp)
        s = [set(), set()]
        for k, p, d in zip(key.tolist(), at.tolist(), side.tolist()):
            s[d].add((k, p))
        sides.append(s)
    assert {p for _, p in sides[0][0] & sides[1][1]} == {p for _, p in sides[1][0] & sides[0][1]} == set(range(400))


@pytest.mark.parametrize("block", [512, 2])
def test_simhash_components(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    texts = list(ODD)
    for _ in range(25):
        base = rng.choice(WORDS, 150).tolist()
        for _ in range(4):
            w = list(base)
            w[rng.integers(0, 150)] = "changed"
            texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = {i: naive_print(t, 3) for i, t in enumerate(texts)}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    want = naive_components(prints)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert len(set(want.values())) < len(set(prints.values()))
    kept = simhash.keep_one(docs_of(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs_of(spark, []).columns


def test_simhash_empty_null_ids_and_repeats(spark):
    df = docs_of(spark, ODD)
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, "a b c"), (None, "z y x w"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(odd).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    assert sorted((r["doc_id"] or -1, r["text"]) for r in simhash.keep_one(odd).collect()) == [(-1, "z y x w"), (3, "a b c")]


def test_keep_one_goes_by_rows(spark):
    def kept(rows):
        df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, h string")
        return sorted((r["doc_id"] or -1, r["text"]) for r in simhash.keep_one(df).collect())

    t, u = "t t t one", "u u u other words"
    assert kept([(None, t), (1, t), (None, u)]) == [(-1, u), (1, t)]
    assert kept([(2, t), (5, t), (5, u)]) == [(2, t), (5, u)]
    assert kept([(5, t), (5, t), (5, u)]) == [(5, t), (5, u)]
    assert kept([(None, None), (None, ""), (None, None)]) in ([(-1, None)], [(-1, "")])
    assert kept([]) == []


def test_simhash_on_the_tables(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = naive_components({i: naive_print(t, 3) for i, t in docs.items()})
    assert {r["doc_id"]: r["component_id"] for r in queries.op3_simhash(spark, SF).collect()} == want


# -- 4 and 9 --------------------------------------------------------------------------------------


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|ann|>"), (1, 2, "bob", "yo"), (1, 3, "cat", None), (1, 300, "ann", "bye"), (1, 300, "ann", "bye"), (2, None, None, "alone"), (3, 0, "system", "x")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["conv_id"], r["perspective"]].append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "cat"), (2, "")}
    for key, rs in by.items():
        rs.sort(key=lambda r: r["position"])
        whole = "".join(r["segment"] for r in rs)
        assert [r["position"] for r in rs] == list(range(1, len(rs) + 1))
        assert all(whole[r["seg_start"] : r["seg_end"]] == r["segment"] for r in rs)
        assert all((r["role"] == "assistant") == r["learned"] for r in rs)
    ann_ = sorted(by[1, "ann"], key=lambda r: r["position"])
    whole = "".join(r["segment"] for r in ann_)
    assert [whole[r["mask_start"] : r["mask_end"]] for r in ann_ if r["learned"]] == ["hi < |ann|><|end|>", "bye<|end|>", "bye<|end|>"]
    assert whole.startswith("<|system|>\nbe nice<|end|>\n<|assistant|>\nhi < |ann|><|end|>\n<|user name=bob|>\nyo<|end|>\n<|user name=cat|>\n<|end|>\n")


def test_copies_do_not_crowd_out_the_samples(spark, monkeypatch):
    monkeypatch.setattr(langid, "train", lambda windows, langs, classes: np.bincount(langs, minlength=classes))
    texts = [(f"eigen {i}", "de") for i in range(20)] + [("kopie", "de")] * 4000 + [(f"own {i}", "en") for i in range(300)]
    df = spark.createDataFrame([(i, t, lang, int(lang == "de")) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string, toxic int")
    model = langid.fit(df, sample_rows=20)
    assert sorted(model["langs"]) == ["de", "en"] and min(model["weights"]) >= 5  # windows of each language, one a text
    got = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: got.append((texts, toxic)))
    toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), sample_each=5)
    assert len(set(got[0][0])) == len(got[0][0]) and (got[0][1].sum(), len(got[0][1])) == (5, 15)


@pytest.mark.parametrize("most", [1, 700, 1500, 10**6])
def test_first_of_each_kind_in_hash_order(spark, most):
    rows = spark.range(9000).selectExpr("xxhash64(id) as h", "if(id % 9 = 0, 'b', if(id < 3, 'c', 'a')) as lang", "id as n", "id as bin")
    want = defaultdict(list)
    for r in rows.collect():
        want[r["lang"]].append((r["h"], r["n"]))
    drawn = common.first_of_each(rows, "lang", "h", most)
    assert sorted(drawn.columns) == sorted(rows.columns)
    got = defaultdict(list)
    for r in drawn.collect():
        got[r["lang"]].append((r["h"], r["n"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:most] for k, v in want.items()}
    assert not common.first_of_each(rows.where("n < 0"), "lang", "h", most).count()


def test_line_dedup(spark):
    pages = [("h", f"Menu\nown {i}\n\nown {i}") for i in range(30)] + [("h", "copy line\nMenu")] * 30 + [(None, "Menu"), ("h", None), ("h", ""), ("g", "Menu\nx")]
    df = spark.createDataFrame([(i, h, t, "z") for i, (h, t) in enumerate(pages)], "page_id long, host string, text string, n_lines string")
    got = {r["page_id"]: r for r in linededup.drop_boilerplate(df, "host").collect()}
    assert got[0]["text"] == "own 0\n\nown 0" and (got[0]["n_lines"], got[0]["n_dropped"]) == (4, 1)
    assert got[31]["text"] == "copy line"  # copies of one page don't make its lines boilerplate
    assert got[60]["text"] == "Menu" and got[61]["text"] is None and got[62]["text"] == "" and got[63]["text"] == "Menu\nx"
    assert len(got) == len(pages) and linededup.drop_boilerplate(df.limit(0), "host").collect() == []


def test_line_dedup_of_large_and_small_hosts(spark):
    pages = [("big", f"own {i}" + "\nLicensed" * (i % 100 == 0) + "\nrare" * (i < 3)) for i in range(800)] + [("small", f"mine {i}\nMenu" + "\ntwice" * (i < 2)) for i in range(5)]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(pages)], "page_id long, host string, text string")
    got = {r["page_id"]: r["text"] for r in linededup.drop_boilerplate(df, "host", ratio=0.005).collect()}
    assert got[100] == "own 100" and got[0] == "own 0\nrare"  # on 1 % of a large host's pages, and on 3 of 800
    assert [got[800], got[804]] == ["mine 0", "mine 4"]  # a small host is cleaned alike
    two = spark.createDataFrame([(0, "h", "Menu\nx", "a"), (1, "h", "Menu\ny", "b"), (2, "i", "Menu\nz", "c")], "page_id long, host string, text string, kept string")
    assert [(r["text"], r["kept"]) for r in linededup.drop_boilerplate(two, "host").orderBy("page_id").collect()] == [("x", "a"), ("y", "b"), ("Menu\nz", "c")]


@pytest.mark.parametrize("pages, least", [(1, 2), (2, 2), (15, 3), (30, 4), (58, 7), (300, 31)])
def test_the_ratio_decides_on_hosts_of_all_sizes(spark, pages, least):
    """A line goes from that number of pages on and stays on one fewer."""
    rows = [(i, "h", f"own {i}" + "\ngoes" * (i < least) + "\nstays" * (i < least - 1)) for i in range(pages)]
    got = linededup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, host string, text string"), "host").select(F.sum("n_dropped"), F.count_if(F.contains("text", F.lit("stays")))).first()
    assert tuple(got) == (least if pages > 1 else 0, min(least - 1, pages))


def test_the_line_query_drops_what_pages_of_a_host_share(spark, tmp_path):
    """All that is on two pages goes on hosts of fewer than 400, and what is on over 0.5 % of the pages on larger ones; as by its SQL."""
    hosts = {1: 2, 2: 2, 30: 2, 58: 2, 399: 2, 400: 3, 800: 5}  # pages: from how many a line goes
    rows = [(f"http://h{n}/{i}", f"<p>own {i}</p>" + "<p>goes</p>" * (i < least) + "<p>stays</p>" * (i < least - 1)) for n, least in hosts.items() for i in range(n)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op9_linededup(spark, str(tmp_path)).select("page_id", "host", "text", "n_lines", "n_dropped").collect()
    dropped, left = Counter(), Counter()
    for r in got:
        dropped[r["host"]] += r["n_dropped"]
        left[r["host"]] += "stays" in r["text"]
    assert {h: (dropped[h], left[h]) for h in dropped} == {f"h{n}": (least if n > 1 else 0, least - 1) for n, least in hosts.items()}
    sql = queries.ORACLE_SQL["op9_linededup"].replace("from pages", f"from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())


def test_one_huge_text_ends_no_sample(spark):
    """Texts behind it in the order of the hash teach as before."""
    texts = [f"clean words number {i} of calm prose. " * 3 for i in range(40)] + [f"vile hatred insult {i}. calm prose." for i in range(40)]
    rows = [(i, t, int(i >= 40)) for i, t in enumerate(texts)] + [(100, "vile endless " * 40000, 1), (101, "calm endless " * 40000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    w = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), sample_chars=20_000)
    some = toxicity.fit(df.where("doc_id < 100").drop("toxic"), df.where("doc_id < 100").select("doc_id", "toxic"))
    assert w == some and len(w) > 3


def test_language_of_three_byte_letters_learns_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda x, y, n: seen.append((x, y)) or {})
    thai, text = "ก" * 1000, "plain words " * 500
    df = spark.createDataFrame([(1, thai, "th"), (2, text, "en"), (3, "1 2 3", "en"), (4, "q " * 300_000, "en")], "doc_id long, text string, lang string")
    assert langid.fit(df, sample_chars=20_000)["langs"] == ["en", "th"]
    x, y = seen[0]
    assert x[y == 1].tobytes().decode(errors="ignore").count("ก") >= 1000 - 2 * len(x[y == 1]) and x[y == 1].tobytes().rstrip(b" ") == thai.encode()
    assert x[y == 0].tobytes().rstrip(b" ") == text.encode().rstrip(b" ")  # the longest text doesn't fit
    many = spark.createDataFrame([(i, f"word {i}", f"l{i % 7}" if i < 21 else f"x{i}") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.fit(many, most_langs=7)["langs"] == [f"l{i}" for i in range(7)]


# -- 5, 6 and 7 -----------------------------------------------------------------------------------


def test_differencing_keeps_every_number_and_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 5000, 2000)
    part, sums = sharding.difference(sizes, 40)
    assert np.array_equal(np.bincount(part, sizes, 40).astype(int), sums)
    assert sums.max() - sums.min() < 50
    assert sharding.difference(np.array([], int), 3)[1].tolist() == [0, 0, 0]
    part, sums = sharding.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums.tolist()) == [14, 16]


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS", 40)
    monkeypatch.setattr(sharding, "FAN", 3)  # several levels
    monkeypatch.setattr(sharding, "SLOTS", 3)
    texts = [*ODD[:8], None, *[f"text number {i} " * (i % 17) for i in range(400)]]
    got = sharding.shard(docs_of(spark, texts), 7).collect()
    assert len(got) == len(texts)
    size, slots, of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 16 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    assert set(size) == set(range(7)) and max(size.values()) - min(size.values()) < 0.02 * max(size.values())
    assert sharding.shard(docs_of(spark, []), 7).collect() == []


def test_packing_round_trip(spark, monkeypatch):
    marks = ["<|endoftext|>", "a <|endoftext|> b", "one<|endoftext|>two <|endoftext|><|endoftext|>", " <|endoftext|> ", "a\n<|endoftext|>\n b", "<|endoftext|"]
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*ODD, "  a\t b \n c  ", *marks])], "doc_id long, text string"))
    monkeypatch.setattr(packing, "BUFFER_TOKENS", 20_000)  # several buffers in a task
    got = packing.pack(rows, P.path("byte_bpe_50k.json")).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert set(by_doc) == set(texts)
    for d, rs in by_doc.items():
        ids = [*t.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(rs, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0 and at == rs[0]["tier"]
    assert packing.pack(rows.limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_tokens_are_those_of_the_library():
    t, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.WordCachingTokenizer(P.path("byte_bpe_50k.json"))
    parts = ["a", "b c", " ", "  ", "\n", "\t", "<|endoftext|>", "Hello", "'s", " 're", "12", "!", "é", "日本", "😀", "|", "<", "\x00", "\u200b", "\u3000", "ß<|endoftext|>x"]
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)]
    for i in range(0, 3000, 50):
        for text, ids in zip(texts[i : i + 50], own.ids_of(texts[i : i + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_routes_remainders_to_their_tiers():
    # nothing longer to fill: short documents stay whole in windows of their own tier
    assert packing.plan([512, 512, 256, 256, 128]) == [[(1, 0, 512)], [(0, 0, 512)], [(3, 0, 256)], [(2, 0, 256)], [(4, 0, 128)]]
    # gaps of the longer tier take the largest shorter remainders that fit
    assert packing.plan([700, 300, 24, 500, 12]) == [[(0, 0, 700), (1, 0, 300), (2, 0, 24)], [(3, 0, 500), (4, 0, 12)]]
    lengths = np.random.default_rng(4).lognormal(6, 1.2, 3000).astype(int) + 1
    plan = packing.plan(lengths.tolist())
    sizes = [sum(n for _, _, n in seq) for seq in plan]
    assert min(Counter(sizes)[t] for t in (1024, 512)) > 50
    for seq, size in zip(plan[:-10], sizes):
        if size < 1024:  # led by a remainder of that very tier
            assert size // 2 < seq[0][2] <= size
    pieces_of = defaultdict(list)
    for d, s, n in (x for seq in plan for x in seq):
        pieces_of[d].append((s, n))
    for d, want in enumerate(lengths):
        at = 0
        for s, n in sorted(pieces_of[d]):
            assert s == at and n > 0
            at += n
        assert at == want
    out, _, groups = packing._emit(list(range(3000)), [b"\0\0\0\0" * n for n in lengths], 0, 0, 1024)
    seqs = out.groupby("sequence_id").first()
    totals = seqs.groupby("step_group")["tier"].sum()
    assert len(totals) == groups > 1 and totals.max() - totals.min() <= 1024
    by_tier = seqs[seqs["tier"] == 512].groupby("step_group").size().reindex(range(groups), fill_value=0)
    assert by_tier.max() - by_tier.min() <= 2


def test_pieces(spark):
    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    extra = [*ODD, "  a  b ", "a▁b ▁▁ c", "é 😀 ﷺ\x00", "\t\n x", " ", "▁"]
    df = docs_of(spark, extra)
    got = pieces.encode(df, model).withColumn("back", pieces.decode(F.col("ids"), model)).collect()
    for r in got:
        ids = sp.encode(r["text"] or "")
        data = (r["text"] or "").encode()
        assert r["ids"] == ids and r["back"] == sp.decode(ids)
        assert b"".join(data[a:b] for a, b in zip(r["starts"], r["ends"])) == data
        assert all(a == b for a, b in zip(r["ends"], r["starts"][1:]))
        assert r["score"] == "clash"
    for r in queries.op7_pieces(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        ids = sp.encode(r["text"])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.encode(df.limit(0), model).collect() == []


def character_map(words: dict[bytes, bytes]) -> bytes:
    """A compiled character map: a double array, laid out state by state, then the replacements."""
    texts, at, units, used, bases = b"", {}, [0] * (1 << 16), {0}, set()
    for v in dict.fromkeys(words.values()):
        at[v] = len(texts)
        texts += v + b"\0"

    def place(prefix: bytes, node: int) -> None:
        labels = [0] * (prefix in words) + sorted({w[len(prefix)] for w in words if w.startswith(prefix) and len(w) > len(prefix)})
        base = next(b for b in range(256, 1 << 16, 256) if b not in bases and all(b ^ x not in used for x in labels))
        bases.add(base)
        used.update(base ^ x for x in labels)
        units[node] |= (node ^ base) << 10
        for x in labels:
            if x:
                units[base ^ x] = x
                place(prefix + bytes([x]), base ^ x)
            else:
                units[node] |= 1 << 8
                units[base] = 1 << 31 | at[words[prefix]]

    place(b"", 0)
    return (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + texts


MAP = {"Ａ": "A", "ﬁ": "fi", "e\u0301": "é", "\t": " ", "ab": "xyz", "a": "a", "\u200b": "", "…": "..."}


@pytest.mark.parametrize("mapped, dummy, squeeze", [(True, True, True), (True, False, False), (False, True, True), (False, True, False)])
def test_pieces_of_models_with_other_normalisers(spark, mapped, dummy, squeeze):
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = pieces.with_normalizer(f.read(), character_map({k.encode(): v.encode() for k, v in MAP.items()}) if mapped else b"", dummy, squeeze)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Encoder(model)
    assert own.plain == (not mapped and dummy and not squeeze)
    rng = np.random.default_rng(5)
    parts = ["a", "b", "ab", "Ａ", "ﬁ", "é", "e\u0301", "\t", " ", "  ", "…", "\u200b", "▁", "日本", "😀", "\n", "hello", "World", "\x00"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(1500)]
    for t, (ids, ends) in zip(texts, own.encode(texts)):
        want = library.encode(t)
        assert np.frombuffer(ids, np.int32).tolist() == want and len(ends) == len(want) + 1
        assert not want or (ends[0] == 0 and (np.diff(ends) >= 0).all() and ends[-1] == len(t.encode()))
    if mapped and dummy:
        df = docs_of(spark, [None, "", "ab ﬁn…", "\u200b", "x  e\u0301\t"])
        got = pieces.encode(df, model, decoded=True).orderBy("doc_id").collect()
        assert [r["ids"] for r in got] == [library.encode(r["text"] or "") for r in got] and [r["decoded"] for r in got] == [library.decode(r["ids"]) for r in got]
        data = got[2]["text"].encode()
        spans = [(library.id_to_piece(i), data[a:b].decode()) for i, a, b in zip(got[2]["ids"], got[2]["starts"], got[2]["ends"])]
        assert ("▁fin", " ﬁn") in spans or ("▁fi", " ﬁ") in spans  # both letters come from one source character
        assert "".join(x for _, x in spans) == got[2]["text"]


def test_character_map_takes_the_longest_prefix():
    # a double array for the keys "a" -> "x" and "ab" -> "yz", laid out by hand
    units = [0] * 1024
    units[0] = 1 << 10  # root: children at 1 ^ label
    a = 1 ^ ord("a")
    base_a = 512
    units[a] = ord("a") | 1 << 8 | (a ^ base_a) << 10
    units[base_a] = (1 << 31) | 0  # value of "a": text 0
    b = base_a ^ ord("b")
    base_b = 768
    units[b] = ord("b") | 1 << 8 | (b ^ base_b) << 10
    units[base_b] = (1 << 31) | 2
    blob = (len(units) * 4).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    m = pieces.CharMap(blob)
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"c", 0) is None
    text, at = pieces.normalize(" ab  c", {"escape": True, "squeeze": True, "dummy": True}, m)
    assert text == "▁yz▁c" and at.tolist() == [1, 1, 1, 3, 5, 6]
