"""The pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline as cp  # noqa: E402

from tessera.llm import langid, toxicity  # noqa: E402
from tessera.llm.common import held_out  # noqa: E402

from .test_operators import naive_components, naive_print  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_stage_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # odd rows: no letters, null and empty text, null language and source, a copy, a line on every page of a source
    odd = [(9001, "123 456", "en", "src1", 7), (9002, None, None, None, None), (9003, "", "en", "src1", 0), (9005, None, "en", "src2", 0), (9006, "words and then a mark <|endoftext|> in the text of this one", "en", "src2", 50)]
    odd += [(9100 + i, f"Common footer line here\nand here is the text that only document {i} has, number {i * 7}", "en", "site", 60) for i in range(30)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    copy = docs.where("doc_id = 3").withColumn("doc_id", F.lit(9004).cast("long"))
    docs = docs.union(copy)
    rows = {r["doc_id"]: r for r in docs.collect()}

    model = langid.fit(docs.where(~held_out()))
    want = {}
    for i, r in rows.items():
        if r["text"] and any(map(str.isalpha, r["text"])):
            p = langid.label_positions(r["text"].encode(), model).mean(0)
            if p.max() >= cp.LEAST_LANGUAGE:
                want[i] = r
    first = cp.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == set(want)
    assert not {9001, 9002, 9003, 9005} & set(want)

    weights = toxicity.fit(first.where(~held_out()), labels.where(~held_out()))
    scorer = toxicity.Scorer(weights)
    want = {i: r for i, r in want.items() if scorer.of_text(r["text"]) < cp.TOXIC}
    second = cp.STAGES[1][1](spark, first, SF)
    assert second.columns == docs.columns and {r["doc_id"] for r in second.collect()} == set(want)

    pages, on = defaultdict(set), defaultdict(set)
    for r in want.values():
        pages[r["source"]].add(r["text"])
    for s, texts in pages.items():
        for t in texts:
            for line in t.split("\n"):
                if line.strip(" "):
                    on[s, line.strip(" ")].add(t)
    gone = {k for k, v in on.items() if len(v) - 1 > cp.BOILERPLATE * (len(pages[k[0]]) - 1)}
    texts = {i: "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in gone) for i, r in want.items()}
    third = cp.STAGES[2][1](spark, second, SF)
    assert third.columns == docs.columns and {r["doc_id"]: r["text"] for r in third.collect()} == texts
    assert ("site", "Common footer line here") in gone
    assert all(r["n_chars"] == len(r["text"]) for r in third.collect())

    comp = naive_components({i: naive_print(t, 3) for i, t in texts.items()})
    kept = {i for i, c in comp.items() if i == c}
    fourth = cp.STAGES[3][1](spark, third, SF)
    assert fourth.columns == docs.columns and {r["doc_id"] for r in fourth.collect()} == kept
    assert not (3 in kept and 9004 in kept)

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = cp.STAGES[4][1](spark, fourth, SF).collect()
    ids = {i: [*t.encode(texts[i], add_special_tokens=False).ids, 0] for i in kept}
    at = defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]]
        at[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : at[r["doc_id"]]], "<u4").tobytes())
    assert dict(at) == {i: len(x) for i, x in ids.items()}


def test_run_applies_the_stages(spark):
    got = cp.run(spark, SF)
    assert got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").isEmpty()
    assert [n for n, _ in cp.STAGES] == ["language_id", "toxicity", "line_dedup", "simhash_near_dedup", "packing"]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, empty, SF)
        assert out.collect() == []
