"""Importance weights against plain counts, the draw, and accuracy on held-out labels."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridlark.llm.registry import table
from gridlark.llm.resample import buckets, gumbel, importance_resample, take_greatest

SCHEMA = "doc_id long, text string, good boolean, score string"


def plain_buckets(text, n):
    w = [x for x in (text or "").lower().encode().split()]
    grams = w + [a + b" " + b for a, b in zip(w, w[1:])]
    return Counter(xxhash.xxh32_intdigest(g) % n for g in grams)


def test_buckets():
    for t in [None, "", " \n", "One", "one Two one two", "é É x", "w " * 250_000]:
        got = buckets(t, 64)
        assert {i: int(c) for i, c in enumerate(got) if c} == dict(plain_buckets(t, 64))


def test_scores_and_draw(spark):
    texts = [f"good words w{i % 7} here" for i in range(60)] + [f"bad ## w{i % 5} &&" for i in range(40)] + [None, " ", "good words"]
    rows = [(i, t, i < 40, "mine") for i, t in enumerate(texts)] + [(None, "bad bad", None, "mine"), (3, texts[3], True, "mine")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = importance_resample(docs, docs.where("good"), share=0.5, n=256)
    got = out.withColumn("noise", gumbel("doc_id")).collect()
    raw, target = np.ones(256), np.ones(256)
    for _, t, good, _ in rows:
        for b, c in plain_buckets(t, 256).items():
            raw[b] += c
            target[b] += c * bool(good)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    text_of = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows) and "text" not in out.columns
    for r in got:
        own = plain_buckets(text_of[r["doc_id"]], 256)
        n = sum(own.values())
        assert r["n_grams"] == n and math.isclose(r["log_weight"], sum(c * ratio[b] for b, c in own.items()), abs_tol=1e-9)
        assert (r["_score"] is None) == (n == 0) and r["score"] == "mine"
    draws = sorted((r["_score"] / 0.005 + r["noise"] for r in got if r["_score"] is not None), reverse=True)
    k = round(0.5 * len(rows) + 1e-9)
    bound = draws[k - 1]
    assert all(r["kept"] == (r["_score"] is not None and r["_score"] / 0.005 + r["noise"] >= bound - 1e-9) for r in got)
    assert importance_resample(docs.limit(0), docs.limit(0)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 7, 14_999, 15_000, 29_990, 30_000, 40_000])
def test_greatest(spark, k):
    rows = spark.range(30_000).select("id", (F.floor(F.xxhash64("id") % 1000) / 7.0).alias("v"), F.lit(1).alias("x"))
    rows = rows.withColumn("v", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("v"))).withColumn("v", F.when(F.col("id") < 10, None).otherwise(F.col("v")))
    got = {r["id"] for r in take_greatest(rows, "v", k, "id", "m").where("m").collect()}
    want = sorted(((-r["v"], r["id"]) for r in rows.collect() if r["v"] is not None))[:k]
    assert got == {i for _, i in want}


def test_noise_is_gumbel(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(gumbel("id")).collect()])
    assert abs(x.mean() - 0.5772) < 0.03 and abs(x.var() - math.pi**2 / 6) < 0.06


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    out = importance_resample(docs, docs.where("quality = 1 AND pmod(xxhash64(doc_id), 2) = 0"), share=0.85)
    held = out.where("quality IS NOT NULL AND pmod(xxhash64(doc_id), 2) = 1").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in held)
    clean = [r["kept"] for r in held if r["quality"] == 1]
    assert len(held) > 150 and right / len(held) > 0.93 and sum(clean) / len(clean) > 0.95
