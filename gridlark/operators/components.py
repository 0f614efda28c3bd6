"""Clusters of nearby points and 1-D persistence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.connected import connected
from gridlark.operators.ordered import largest_group

_POINT = "struct<x:double,y:double,id:bigint>"


def fold_components(points: Column, eps: float) -> Column:
    """Clusters of a short array of ``struct<x, y, id>``: an array of point arrays."""

    def step(done, p):
        near = lambda c: F.exists(
            c, lambda q: (q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]) <= F.lit(eps * eps)
        )
        joined = F.concat(F.flatten(F.filter(done, near)), F.array(p))
        return F.concat(F.filter(done, lambda c: ~near(c)), F.array(joined))

    return F.aggregate(points.cast(f"array<{_POINT}>"), F.array().cast(f"array<array<{_POINT}>>"), step)


def components(
    points: DataFrame, keys: Sequence[str], point: str, eps: float, small: int = 64, size: int | None = None
) -> DataFrame:
    """Add `component`, the least point id reachable by steps of at most `eps`.

    Groups that are small are folded in the JVM, one array each. Otherwise points are
    linked through grid cells and the links joined to components, so no group is
    gathered. `size` is a known bound on the group size; both ways label alike.
    """
    keys = list(keys)
    if size is None or size > small:
        size = largest_group(points.select(*keys), keys)
    pts = points.select(*keys, F.col(point).cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if size <= small:
        rows = F.sort_array(F.collect_list(F.struct("x", "y", "id")))
        clusters = pts.groupBy(*keys).agg(fold_components(rows, eps).alias("_c"))
        each = clusters.select(*keys, F.explode("_c").alias("_c"))
        labelled = each.select(*keys, F.explode("_c").alias("_p"), F.array_min(F.transform("_c", lambda p: p["id"])).alias("component"))
        return labelled.select(*keys, F.col("_p.id").alias(point), F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), "component")

    # equal points collapse first; cells of side eps keep the link search local
    spots = pts.groupBy(*keys, "x", "y").agg(F.min("id").alias("id"))
    cell = lambda c: F.floor(F.col(c) / eps).cast("bigint")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = spots.select(*keys, "id", "x", "y", cell("x").alias("_cx"), cell("y").alias("_cy"))
    right = spots.select(*keys, F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    right = right.withColumn("_cx", F.explode(F.transform(near, lambda o: F.col("_cx") + o)))
    right = right.withColumn("_cy", F.explode(F.transform(near, lambda o: F.col("_cy") + o)))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    links = left.join(right, [*keys, "_cx", "_cy"]).where((F.col("id") != F.col("id2")) & (dx * dx + dy * dy <= eps * eps))
    node = lambda c: F.struct(*keys, F.col(c).alias("id"))
    roots = connected(links.select(node("id").alias("a"), node("id2").alias("b")))
    roots = roots.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.id").alias("id"), F.col("root.id").alias("label"))
    labels = spots.select(*keys, "id").join(roots, [*keys, "id"], "left").withColumn("label", F.coalesce("label", "id"))
    home = spots.withColumnRenamed("id", "_spot").join(labels.withColumnRenamed("id", "_spot"), [*keys, "_spot"])
    return pts.join(home.select(*keys, "x", "y", "label"), [*keys, "x", "y"]).select(
        *keys, F.col("id").alias(point), "x", "y", F.col("label").alias("component")
    )


def _pairs(values: np.ndarray, keep: int) -> list[tuple[float, float]]:
    """Birth and death of each basin as the level rises over the series."""
    basin = np.full(len(values), -1)
    low: dict[int, float] = {}
    out = []
    for i in np.argsort(values, kind="stable"):
        level = float(values[i])
        sides = sorted({int(basin[j]) for j in (i - 1, i + 1) if 0 <= j < len(values) and basin[j] >= 0}, key=lambda b: low[b])
        if not sides:
            low[int(i)] = level
            basin[i] = i
            continue
        # the point itself is born and absorbed at once, then the younger basin ends here
        out.append((level, level))
        basin[i] = sides[0]
        for gone in sides[1:]:
            out.append((low.pop(gone), level))
            basin[basin == gone] = sides[0]
    top = float(values.max())
    out.extend((b, top) for b in low.values())
    return sorted(out, key=lambda p: p[0] - p[1])[:keep]


def persistence(series: Column) -> Column:
    """Longest-lived eight (birth, death) pairs of each short series, in Arrow batches."""

    @F.pandas_udf("array<struct<birth:double,death:double>>")
    def pairs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [
                    [] if v is None or len(v) == 0 else [{"birth": b, "death": d} for b, d in _pairs(np.asarray(v, float), 8)]
                    for v in batch
                ]
            )

    return pairs(series)
