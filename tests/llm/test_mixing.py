"""The mix: targets by resharing, whole documents, schedules and odd rows."""

import random

from pyspark.sql import functions as F

from gridlark.llm.mixing import SCHEDULES, curriculum, due, sized, training_order

SCHEMA = "doc_id long, source string, size long, target string"


def reshared(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    got, left, open_ = dict.fromkeys(names, 0.0), float(total), set(names)
    while left > 1e-9 * max(1, total) and open_:
        over, whole = 0.0, sum(w[s] for s in open_)
        for s in sorted(open_, key=str):
            got[s] += left * w[s] / whole
            if got[s] >= most * sizes[s]:
                over += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
        open_ = {s for s in open_ if got[s] < most * sizes[s]}
        left = over
    return got


def test_targets_and_taken_words(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["b", "a", None, "Z", "é", "hot", "hot", "hot"]), rng.randrange(0, 400), "x") for i in range(3000)]
    rows += [(9000, "tiny", 5, "x"), (None, "tiny", 7, "x"), (9000, "tiny", 5, "x"), (9001, "huge", 200000, "x"), (9002, "none", 0, "x")]
    facts = spark.createDataFrame(rows, SCHEMA).drop("target")
    out = curriculum(facts, pieces=16).collect()
    assert len(out) == len(rows)
    sizes, largest, taken = {}, {}, {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    want = reshared(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        assert len(r["copies"]) <= 3 and all(0 <= c["position"] <= 1 for c in r["copies"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * len(r["copies"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = curriculum(facts.repartition(13), pieces=500).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_schedule_is_inverted(spark):
    for schedule in SCHEDULES:
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("u"), due(schedule, F.col("id") / 100).alias("t")).collect()
        whole = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:]))
        for r in rows:
            area = 0.0
            for (t0, a), (t1, b) in zip(schedule, schedule[1:]):
                x = min(max(r["t"], t0), t1) - t0
                area += a * x + (b - a) / (t1 - t0) * x * x / 2
            assert abs(area / whole - r["u"]) < 1e-9


def test_rates_change_over_training(spark):
    rows = [(i, "abc"[i % 3], 10, "x") for i in range(6000)]
    order = training_order(curriculum(spark.createDataFrame(rows, SCHEMA).drop("target")), 4)
    half = order.groupBy("source").agg(F.sum((F.col("position") < 0.5).cast("int")).alias("early"), F.count("*").alias("n"))
    share = {r["source"]: r["early"] / r["n"] for r in half.collect()}
    assert share["a"] > 0.6 and abs(share["b"] - 0.5) < 0.02 and share["c"] < 0.35
    got = [r["position"] for r in order.collect()]
    assert got == sorted(got)


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert curriculum(sized(docs)).count() == 0
    docs = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id long, text string, source string")
    assert [r["copies"] for r in curriculum(sized(docs)).collect()] == [[], []]
