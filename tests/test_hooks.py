"""A caller's functions: isolation of bad rows, one set-up per worker, fallback."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlark.operators.hooks import embed_rows, histogram_features, score_rows


def rooted():
    """A fresh object per set-up, whose id tells set-ups apart."""
    made = object()

    def fn(given):
        x = given["x"].to_numpy(zero_copy_only=False)
        if len(x) > 50:
            raise MemoryError("batch too large")
        if np.isnan(x).any() or (x < 0).any():
            raise ValueError("bad row")
        return {"root": np.sqrt(x), "who": pa.array([id(made)] * len(x), pa.int64())}

    return fn


def test_only_bad_rows_fail(spark):
    rows = [(k, None if k % 97 == 5 else float(-k if k % 31 == 0 and k else k), "t") for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, x double, text string").repartition(3)
    out = score_rows(df, rooted, ["x"], "root double, who bigint", batch_rows=50)
    assert out.columns == ["k", "x", "text", "root", "who", "error"]
    got = {r["k"]: r for r in out.collect()}
    assert len(got) == 1000
    for k, x, _ in rows:
        bad = x is None or x < 0
        assert got[k]["error"] == ("ValueError: bad row" if bad else None) and got[k]["root"] == (None if bad else x**0.5)
    # a batch that does not fit is halved until it does
    assert score_rows(df.where("x >= 0"), rooted, ["x"], "root double, who bigint", batch_rows=400).where("error is not null").count() == 0


def test_set_up_once_per_worker(spark):
    df = spark.range(0, 4000, numPartitions=16).select(F.col("id").cast("double").alias("x"))
    out = score_rows(df, rooted, ["x"], "root double, who bigint", batch_rows=50)
    assert out.select("who").distinct().count() <= 2 * spark.sparkContext.defaultParallelism


def test_wrong_results_are_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string").coalesce(1)
    short = score_rows(df, lambda: lambda given: {"z": [1][: len(given["x"]) - 1]}, ["x"], "z int").collect()
    assert all(r["z"] is None and r["error"].startswith("ValueError") for r in short)
    typed = score_rows(df, lambda: lambda given: {"z": given["y"].to_pylist()}, ["y"], "z int").collect()
    assert all(r["z"] is None and r["error"].startswith("ArrowInvalid") for r in typed)
    missing = score_rows(df, lambda: lambda given: {}, ["y"], "z int").collect()
    assert all(r["error"].startswith("KeyError") for r in missing)
    assert score_rows(df.limit(0), rooted, ["x"], "root double").count() == 0
    for returns, error in (("X double", "error"), ("z int", "Y"), ("z int, Z int", "error")):
        with pytest.raises(ValueError, match="taken"):
            score_rows(df, rooted, ["x"], returns, error=error)
    with pytest.raises(ValueError):
        score_rows(df, rooted, ["x"], "z int", batch_rows=0)


def test_fallback_row_by_row(spark):
    def embedder():
        def fn(given):
            names = given["name"].to_pylist()
            if "boom" in names:
                raise RuntimeError("no")
            return {"vector": [None if n is None else [float(len(n))] * 3 for n in names]}

        return fn

    rows = [("ab", [0.0, 0.9]), (None, [0.1]), ("boom", []), ("boom", None), ("cdef", [5.0, -5.0, None])]
    df = spark.createDataFrame(rows, "name string, pixels array<double>").coalesce(1)
    out = embed_rows(df, embedder, ["name"], histogram_features(F.col("pixels"), 2, 0.0, 1.0), 4).collect()
    assert [(r["vector"], r["embedded"], r["embed_error"]) for r in out] == [
        ([2.0, 2.0, 2.0, 0.0], True, None),
        ([1.0, 0.0, 0.0, 0.0], False, None),
        ([0.0, 0.0, 0.0, 0.0], False, "RuntimeError: no"),
        ([0.0, 0.0, 0.0, 0.0], False, "RuntimeError: no"),
        ([4.0, 4.0, 4.0, 0.0], True, None),
    ]
    with pytest.raises(ValueError, match="vector"):
        embed_rows(df.withColumnRenamed("pixels", "Vector"), embedder, ["name"], F.col("Vector"), 4)
