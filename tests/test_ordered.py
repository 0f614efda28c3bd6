"""Large groups are cut into slices; the values must not change."""

import random

import pytest
from pyspark.sql import functions as F

from gridlark.operators import metrics, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(40), i, rng.randrange(9) - 4) for i in range(900)]
    data = [(k, a, i, None if v == 4 else v) for k, a, i, v in data]
    return spark.createDataFrame(data, "k string, a int, i int, v int")


def specs():
    return {
        "n": ("sum", F.lit(1).cast("bigint"), True),
        "s": ("sum", F.coalesce("v", F.lit(0)).cast("bigint"), False),
        "hi": ("max", F.col("v"), False),
        "lo": ("min", F.col("v"), True),
        "last": ("last", F.col("v"), False),
    }


@pytest.mark.parametrize("part", [["k"], []])
def test_sliced_equals_plain(rows, part):
    plain = ordered.running(rows, part, ["a", "i"], specs(), hot_rows=10_000)
    cut = ordered.running(rows, part, ["a", "i"], specs(), hot_rows=60)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_hot_group_is_spread(rows):
    numbered = ordered.number_rows(rows, ["k"], ["a", "i"], "n", hot_rows=60)
    got = numbered.where("k = 'hot'").select("n").collect()
    assert sorted(r.n for r in got) == list(range(1, len(got) + 1))


def test_slices_by_time(spark):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    data = [("k", start + dt.timedelta(milliseconds=777 * ((i * 37) % 200)), i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, i int")
    order = ["t", "i"]
    plain = ordered.number_rows(df, ["k"], order, "n").collect()
    assert sorted(map(str, plain)) == sorted(map(str, ordered.number_rows(df, ["k"], order, "n", hot_rows=15).collect()))


def test_islands(spark):
    df = spark.createDataFrame([(1, 0, 3), (2, 2, 9), (3, 5, 6), (4, 10, 11), (5, 11, 12)], "id int, lo int, hi int")
    for hot in (100, 2):
        got = {r.id: r.g for r in ordered.islands(df, [], "lo", "hi", ["id"], "g", hot_rows=hot).collect()}
        assert got == {1: 0, 2: 0, 3: 0, 4: 10, 5: 10}


@pytest.mark.parametrize("accuracy,few", [(5, 3), (1000, 40), (10_000, 10_000)])
def test_percentiles_by_selection_equal_plain(rows, accuracy, few):
    """However bad the sketch is, the rank is found; one group is null and one has no values."""
    df = rows.withColumn("x", F.col("a") + F.coalesce("v", F.lit(0)) / 7)
    df = df.withColumn("k", F.when(F.col("k") != "k1", F.col("k"))).withColumn("x", F.when(F.col("k") != "k2", F.col("x")))
    shares = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    plain = {r.k: r for r in metrics.exact_percentiles(df, ["k"], "x", shares).collect()}
    cut = {r.k: r for r in metrics.exact_percentiles(df, ["k"], "x", shares, hot_rows=50, accuracy=accuracy, few=few).collect()}
    assert plain.keys() == cut.keys() and None in plain
    for k in plain:
        for name in shares:
            assert plain[k][name] == pytest.approx(cut[k][name], abs=1e-12) if plain[k][name] is not None else cut[k][name] is None


def test_percentiles_without_keys(rows):
    df = rows.select(F.col("a").cast("double").alias("x"))
    one = metrics.exact_percentiles(df, [], "x", {"p": 0.37}).first().p
    two = metrics.exact_percentiles(df, [], "x", {"p": 0.37}, hot_rows=10, accuracy=100, few=5).first().p
    assert one == pytest.approx(two)


def test_plan_does_not_grow_with_slices(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("i"), (F.col("id") % 3).alias("v"))
    sizes = []
    for hot in (5_000, 200):
        out = ordered.running(df, [], ["i"], {"s": ("sum", F.col("v"), True)}, hot_rows=hot)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        assert [r.s for r in out.orderBy("i").select("s").collect()][-1] == df.agg(F.sum("v")).first()[0]
    assert sizes[1] < 1.1 * sizes[0]


def test_null_groups(spark):
    rows = [(None if k % 2 else "a", k, 1) for k in range(60)] + [("b", 1, 1)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for hot in (1000, 10):
        got = {(r.k, r.i): r.n for r in ordered.number_rows(df, ["k"], ["i"], "n", hot_rows=hot).collect()}
        assert got == {("b", 1): 1, **{(None if k % 2 else "a", k): k // 2 + 1 for k in range(60)}}
