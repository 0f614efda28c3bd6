"""Counts, exact percentiles and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.operators.ordered import HOT_ROWS, largest_group
from gridlark.session import stored_table


FEW = 10_000  # values of a bracket that are sorted as they are
_PIVOTS = 63


def _beside(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what a small table says about their group; null groups are groups."""
    named = small.toDF(*[f"_h_{c}" if c in keys else c for c in small.columns])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    return rows.join(F.broadcast(named), same).drop(*[f"_h_{c}" for c in keys])


def _selected(rows: DataFrame, keys: list[str], targets: DataFrame, few: int, accuracy: int) -> DataFrame:
    """``(keys, _name, _value)``: the value of rank `_k` (from 0) among each group's `_v`.

    Every target has a bracket of values. A round takes pivots of the values inside from a
    mergeable sketch, counts the values between and at them exactly and goes on with the
    cell that holds the rank. Pivots are values of the bracket and have cells of their
    own, so each round makes it smaller whatever the sketch says; a cell of one value is
    the answer, and a cell of `few` rows is sorted. Nothing but counts is shuffled before.
    """
    group = [*keys, "_name"]
    done = None
    while True:
        packed = targets.groupBy(*keys).agg(F.collect_list(F.struct("_name", "_k", "_lo", "_hi", "_below", "_in")).alias("_t"))
        inside = _beside(rows, packed, keys).select(*keys, "_v", F.explode("_t").alias("_t")).select(*keys, "_v", "_t.*")
        inside = inside.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        small = inside.where(F.col("_in") <= few).groupBy(*group, "_k", "_below").agg(F.array_sort(F.collect_list("_v")).alias("_vs"))
        found = small.select(*group, F.get("_vs", (F.col("_k") - F.col("_below")).cast("int")).alias("_value"))
        done = found if done is None else done.union(found)
        large = targets.where(F.col("_in") > few)
        if large.isEmpty():
            return done
        wide = inside.where(F.col("_in") > few)
        marks = F.array(*[F.lit(i / (_PIVOTS + 1)) for i in range(1, _PIVOTS + 1)])
        pivots = stored_table(wide.groupBy(*group).agg(F.array_distinct(F.percentile_approx("_v", marks, accuracy)).alias("_p")))
        cut = _beside(wide, pivots, group)
        upto = F.size(F.filter("_p", lambda p: p <= F.col("_v")))
        at = F.when((upto > 0) & (F.get("_p", upto - 1) == F.col("_v")), 2 * upto - 1).otherwise(2 * upto)
        cells = cut.groupBy(*group, "_k", "_below", at.alias("_cell")).agg(F.count("*").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # at most 127 cells per target
        line = W.partitionBy(*group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
        counted = cells.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_in").over(line), F.lit(0)))
        held = counted.where((F.col("_k") >= F.col("_below")) & (F.col("_k") < F.col("_below") + F.col("_in")))
        held = stored_table(held.select(*group, "_k", "_lo", "_hi", "_below", "_in"))
        done = done.union(held.where("_lo = _hi").select(*group, F.col("_lo").alias("_value")))
        targets = held.where("_lo < _hi")
        if targets.isEmpty():
            return done


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float],
    hot_rows: int = HOT_ROWS, accuracy: int = 10_000, few: int = FEW,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of `shares`.

    Groups of bounded size use the built-in exact aggregate. In larger ones the two values
    around each rank are selected by counting, see `_selected`. Null values do not count;
    a group without values has null percentiles.
    """
    keys = list(keys)
    if largest_group(df, keys) <= hot_rows:
        return _built_in(df, keys, value, shares)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"), F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    # fewer than rows / hot_rows groups can pass this filter, so the table is small
    hot = stored_table(sizes.where(F.col("_rows") > hot_rows))
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    wanted = F.array(*[
        F.struct(F.lit(f"{name} {side}").alias("_name"), rule(F.lit(q) * (F.col("_n") - 1)).cast("bigint").alias("_k"))
        for name, q in shares.items() for side, rule in (("a", F.floor), ("b", F.ceil))
    ])
    bounds = [F.col("_lo").cast("double").alias("_lo"), F.col("_hi").cast("double").alias("_hi"), F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_in")]
    targets = hot.where("_n > 0").select(*keys, F.explode(wanted).alias("_w"), *bounds)
    targets = targets.select(*keys, "_w.*", "_lo", "_hi", "_below", "_in")
    found = stored_table(_selected(rows, keys, targets, few, accuracy))
    values = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == f"{n} {x}", F.col("_value"))).alias(f"_{x}_{n}") for n in shares for x in "ab"])
    named = values.toDF(*[f"_h_{c}" if c in keys else c for c in values.columns])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    both = hot.join(F.broadcast(named), same, "left")

    def between(name: str, q: float):
        at = F.lit(q) * (F.col("_n") - 1)
        return F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * (at - F.floor(at))

    out = both.select(*keys, *[between(n, q).alias(n) for n, q in shares.items()])
    if not keys:
        return out
    match = F.lit(True)
    crowd = hot.select(*[F.col(c).alias(f"_h_{c}") for c in keys])
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    return out.unionByName(_built_in(df.join(F.broadcast(crowd), match, "left_anti"), keys, value, shares))


def _built_in(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    got = F.percentile(value, F.array(*[F.lit(q) for q in shares.values()]))
    out = df.groupBy(*keys).agg(got.alias("_p"))
    return out.select(*keys, *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(shares)])


def latency_summary(df: DataFrame, keys: Sequence[str], value: str, **options) -> DataFrame:
    """Mean, p50, p90, p95, p99 and frames per second of a latency column in ms."""
    marks = exact_percentiles(df, keys, value, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, **options)
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean_ms"))
    fps = F.when(F.col("mean_ms") > 0, 1000.0 / F.col("mean_ms")).otherwise(F.lit(0.0))
    return means.join(marks, list(keys)).withColumn("fps", fps)


def scale_factor(df: DataFrame, value: str, keys: Sequence[str] = (), **options) -> DataFrame:
    """127 over the 99.99th percentile of magnitudes (at least 1e-4); 127 for no rows."""
    sized = df.withColumn("_abs", F.abs(F.col(value)))
    top = exact_percentiles(sized, keys, "_abs", {"_top": 0.9999}, **options)
    scale = F.coalesce(127.0 / F.greatest(F.col("_top"), F.lit(1e-4)), F.lit(127.0))
    return top.select(*keys, scale.alias("scale"))


def run_summary(frames: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return frames.groupBy(*keys).agg(
        F.count("*").alias("frames"), F.count_if("skipped").alias("skipped"), F.count_if("inferred").alias("inferred")
    )


def class_image_counts(boxes: DataFrame, image: str, cls: str) -> DataFrame:
    """Images per class; an image counts once per class however many boxes it has."""
    return boxes.select(image, cls).distinct().groupBy(cls).agg(F.count("*").alias("n_images"))


def duty_fraction(frames: DataFrame, keys: Sequence[str], order: Sequence[str], detect: str, **options) -> DataFrame:
    """Detections so far over frames so far."""
    from gridlark.operators.ordered import running

    run = running(
        frames, keys, order,
        {"_d": ("sum", F.col(detect).cast("bigint"), True), "_f": ("sum", F.lit(1).cast("bigint"), True)}, **options,
    )
    return run.withColumn("duty_frac", F.col("_d") / F.greatest(F.lit(1), F.col("_f"))).drop("_d", "_f")
