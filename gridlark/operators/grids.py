"""Magnitude grids in long form: ``map_id, r, d, mag``."""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.functions.vectors import let
from gridlark.operators.components import fold_components


def magnitudes(cells: DataFrame) -> DataFrame:
    return cells.withColumn("mag", F.abs(F.col("mag")))


def cheap_energy(cells: DataFrame, light: bool = False) -> DataFrame:
    energy = F.avg("mag") if light else F.avg("mag") + F.max("mag") * 0.05
    return magnitudes(cells).groupBy("map_id").agg(energy.alias("energy"))


def row_profile(cells: DataFrame) -> DataFrame:
    return magnitudes(cells).groupBy("map_id", "r").agg(F.avg("mag").alias("profile"))


def kernel(sigma: float) -> list[tuple[int, float]]:
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [(k - radius, w / total) for k, w in enumerate(raw)]


def _smooth_line(line: Column, sigma: float) -> Column:
    """Weighted sums along one array; indices beyond an end are mirrored back."""
    weights = [w for _, w in kernel(sigma)]
    radius = len(weights) // 2
    taps = F.lit(weights)
    n = F.size(line)

    def mirrored(i):
        m = F.pmod(i, 2 * n)
        return F.get(line, F.when(m < n, m).otherwise(2 * n - 1 - m))

    padded = F.transform(F.sequence(F.lit(-radius), n - 1 + radius), mirrored)

    def weighted(p):
        near = lambda i: F.zip_with(taps, F.slice(p, i + 1, F.lit(2 * radius + 1)), lambda w, v: w * v)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(near(i), F.lit(0.0), lambda s, x: s + x))

    return let(padded, weighted)


def smooth(cells: DataFrame, sigmas: Sequence[float] = (1.0, 2.0, 4.0)) -> DataFrame:
    """Gaussian-smoothed layers ``s0, s1, ..`` of every full grid; one with holes fails the run.

    The filter is applied line by line along d, then along r, so the widest row ever
    built is one grid line, and each pass moves every cell once.
    """
    names = [f"s{i}" for i in range(len(sigmas))]
    lines = magnitudes(cells).groupBy("map_id", "r").agg(F.sort_array(F.collect_list(F.struct("d", "mag"))).alias("_l"))
    extent = lambda c: F.max(c) - F.min(c) + 1
    whole = cells.groupBy("map_id").agg((extent("r").cast("bigint") * extent("d") == F.count("*")).alias("_whole"))
    holes = F.raise_error(F.lit("a grid has holes or repeated cells")).cast(dict(lines.dtypes)["_l"])
    lines = lines.join(whole, "map_id").withColumn("_l", F.when(F.col("_whole"), F.col("_l")).otherwise(holes))
    across = lines.select(
        "map_id", "r", F.col("_l.d").alias("d"), *[_smooth_line(F.col("_l.mag"), s).alias(n) for n, s in zip(names, sigmas)]
    )
    flat = across.select("map_id", "r", F.explode(F.arrays_zip("d", *names)).alias("_z")).select("map_id", "r", "_z.*")
    columns = flat.groupBy("map_id", "d").agg(F.sort_array(F.collect_list(F.struct("r", *names))).alias("_l"))
    down = columns.select(
        "map_id", "d", F.col("_l.r").alias("r"), *[_smooth_line(F.col(f"_l.{n}"), s).alias(n) for n, s in zip(names, sigmas)]
    )
    return down.select("map_id", "d", F.explode(F.arrays_zip("r", *names)).alias("_z")).select("map_id", "_z.r", "d", *[f"_z.{n}" for n in names])


def local_maxima(cells: DataFrame, value: str, min_rel: float = 0.35) -> DataFrame:
    """Interior cells not below any of their eight neighbours and above a share of the map's top."""
    along = W.partitionBy("map_id", "r").orderBy("d").rangeBetween(-1, 1)
    down = W.partitionBy("map_id", "d").orderBy("r").rangeBetween(-1, 1)
    peaks = cells.withColumn("_row", F.max(value).over(along)).withColumn("_box", F.max("_row").over(down))
    frame = cells.groupBy("map_id").agg(
        F.max("r").alias("_r"), F.max("d").alias("_d"), F.max(value).alias("_top")
    )
    joined = peaks.join(frame, "map_id")
    inside = F.col("r").between(1, F.col("_r") - 1) & F.col("d").between(1, F.col("_d") - 1)
    tall = F.col(value) >= min_rel * (F.col("_top") + F.lit(1e-6))
    return joined.where(inside & tall & (F.col(value) >= F.col("_box"))).drop("_row", "_box", "_r", "_d", "_top")


def top_peaks(peaks: DataFrame, score: str, k: int = 8) -> DataFrame:
    """The k best peaks of each map; Spark keeps k per task before the shuffle."""
    order = W.partitionBy("map_id").orderBy(F.col(score).desc(), "r", "d")
    return peaks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stable_peaks(
    cells: DataFrame, sigmas: Sequence[float] = (1.0, 2.0, 4.0), min_rel: float = 0.35, coarse_rel: float = 0.2, k: int = 8
) -> DataFrame:
    """Peaks of the finest layer that are still strong on the coarsest; score is the layer mean."""
    # nine digits make equal neighbours equal whatever the order of summation
    layers = smooth(cells, sigmas).withColumn("_fine", F.round("s0", 9))
    last = f"s{len(sigmas) - 1}"
    coarse = layers.groupBy("map_id").agg(F.max(last).alias("_coarse"))
    fine = local_maxima(layers, "_fine", min_rel).join(coarse, "map_id")
    strong = fine.where(F.col(last) >= coarse_rel * F.col("_coarse"))
    mean = sum((F.col(f"s{i}") for i in range(1, len(sigmas))), F.col("s0")) / len(sigmas)
    return top_peaks(strong.withColumn("score", F.round(mean, 9)), "score", k).select("map_id", "r", "d", "score", "rank")


def grid_features(cells: DataFrame, peaks: DataFrame, eps: float = 3.0) -> DataFrame:
    """Nine named numbers per map from its profile, its cells and at most a few peaks."""
    profile = row_profile(cells).groupBy("map_id").agg(
        F.max(F.abs("profile")).alias("profile_max"),
        (F.max_by("r", F.struct(F.abs("profile"), -F.col("r"))) / F.count("*")).alias("profile_argmax"),
    )
    stats = magnitudes(cells).groupBy("map_id").agg(
        F.avg("mag").alias("mean"), F.max("mag").alias("max"), (F.max("r") + 1).alias("_rows"), (F.max("d") + 1).alias("_cols")
    )
    spots = F.sort_array(F.collect_list(F.struct(F.col("r").cast("double").alias("x"), F.col("d").cast("double").alias("y"), F.col("rank").cast("bigint").alias("id"))))
    found = peaks.groupBy("map_id").agg(
        F.count("*").alias("n_peaks"), F.max("score").alias("peak_max"), F.avg("r").alias("_pr"), F.avg("d").alias("_pd"),
        F.size(fold_components(spots, eps)).alias("clusters"),
    )
    zero = F.lit(0.0)
    joined = stats.join(profile, "map_id").join(found, "map_id", "left")
    return joined.select(
        "map_id", "profile_max", "profile_argmax", "mean", "max",
        F.coalesce("n_peaks", F.lit(0).cast("bigint")).alias("n_peaks"),
        F.coalesce("peak_max", zero).alias("peak_max"),
        F.coalesce(F.col("_pr") / F.greatest(F.col("_rows"), F.lit(1)), zero).alias("peak_r"),
        F.coalesce(F.col("_pd") / F.greatest(F.col("_cols"), F.lit(1)), zero).alias("peak_d"),
        F.coalesce(F.col("clusters").cast("bigint"), F.lit(0).cast("bigint")).alias("clusters"),
    )


def light_or_full(cells: DataFrame, triggered: DataFrame, threshold: float) -> DataFrame:
    """Which maps get the full treatment: those triggered elsewhere or loud enough."""
    energy = cheap_energy(cells).join(triggered, "map_id", "left")
    full = F.coalesce(F.col("triggered"), F.lit(False)) | (F.col("energy") >= threshold)
    return energy.withColumn("path", F.when(full, "full").otherwise("light"))


def channel_histogram(pixels: DataFrame, keys: Sequence[str], channels: Sequence[str], bins: int = 16, top: int = 256) -> DataFrame:
    """Share of pixels per channel and bin; only bins that occur have a row."""
    width = top / bins
    long = pixels.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels])).alias("_p"))
    binned = long.where((F.col("_p.v") >= 0) & (F.col("_p.v") < top)).select(
        *keys, F.col("_p.channel").alias("channel"), F.floor(F.col("_p.v") / width).cast("int").alias("bin")
    )
    counts = binned.groupBy(*keys, "channel", "bin").count()
    totals = counts.groupBy(*keys, "channel").agg(F.sum("count").alias("_n"))
    return counts.join(totals, [*keys, "channel"]).select(*keys, "channel", "bin", (F.col("count") / (F.col("_n") + F.lit(1e-6))).alias("share"))


def angle_histogram(pixels: DataFrame, keys: Sequence[str], bins: int = 8) -> DataFrame:
    """Gradient angles in degrees, weighted by magnitude."""
    deg = F.degrees(F.atan2("gy", "gx"))
    turn = F.when(deg < 0, deg + 360.0).otherwise(deg)
    placed = pixels.select(
        *keys, F.least(F.floor(turn / (360.0 / bins)), F.lit(bins - 1)).cast("int").alias("bin"),
        F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("mag"),
    )
    sums = placed.groupBy(*keys, "bin").agg(F.sum("mag").alias("_m"))
    totals = sums.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    return sums.join(totals, list(keys)).select(*keys, "bin", (F.col("_m") / (F.col("_n") + F.lit(1e-6))).alias("share"))
