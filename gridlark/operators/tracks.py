"""Track states: publishing rules, filters and the multi-object tracker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(
    tracks: DataFrame,
    enabled: bool = True,
    min_hits: int = 2,
    max_coast: int = 12,
    need_gallery: bool = False,
    min_score: float = 0.12,
) -> DataFrame:
    """Tracks fit to be passed on."""
    if not enabled:
        return tracks.where(F.col("hits") >= 1)
    rule = (F.col("hits") >= min_hits) & F.col("confirmed") & (F.col("time_since_update") <= max_coast)
    if need_gallery:
        named = F.coalesce(F.col("gallery_class"), F.lit("")) != ""
        rule = rule & named & (F.coalesce(F.col("gallery_score"), F.lit(0.0)) >= min_score)
    return tracks.where(rule)


def confirm(tracks: DataFrame, min_hits: int = 2) -> DataFrame:
    return tracks.withColumn("confirmed", F.col("hits") >= min_hits)


def since_last(frames: DataFrame, keys, order: str, event: str, every: int = 5, **options) -> DataFrame:
    """Frames since the last row with `event`, and whether a refresh is due."""
    from gridlark.operators.ordered import largest_group, running

    options = {"size": largest_group(frames, keys), **options}
    run = running(frames, keys, [order], {"_pos": ("sum", F.lit(1).cast("bigint"), True)}, **options)
    run = running(run, keys, [order], {"_hit": ("last", F.when(F.col(event), F.col("_pos")), True)}, **options)
    gap = F.col("_pos") - F.col("_hit")
    due = gap.isNull() | (gap >= every)
    return run.withColumns({"since": gap, "due": due}).drop("_pos", "_hit")


def stalls(rows: DataFrame, keys, ts_us: str, tie: str, minutes: float, **options) -> DataFrame:
    """Rows that follow a silence of more than `minutes`, with its length in seconds."""
    from gridlark.operators.ordered import running

    prev = running(rows, keys, [ts_us, tie], {"_prev": ("last", F.col(ts_us), False)}, **options)
    gap = (F.col(ts_us) - F.col("_prev")) / F.lit(1e6)
    return prev.withColumn("gap_s", gap).where(F.col("gap_s") > minutes * 60).drop("_prev")


def last_row(rows: DataFrame, keys, order, columns) -> DataFrame:
    """Latest row per key as a mergeable maximum."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[f"_row.{c}" for c in columns])
