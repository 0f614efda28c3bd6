"""When to run the detector: a small state machine per stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.operators import overlap
from gridlark.operators.ordered import largest_group, running
from gridlark.operators.windows import crop_plan
from gridlark.session import cut_lineage, stored_table

BLOCK = 256


def track_box(tracks: DataFrame) -> DataFrame:
    return tracks.withColumns(
        {
            "x1": F.col("x") - F.col("w") * 0.5, "y1": F.col("y") - F.col("h") * 0.5,
            "x2": F.col("x") + F.col("w") * 0.5, "y2": F.col("y") + F.col("h") * 0.5,
        }
    )


def loose_regions(rois: DataFrame, tracks: DataFrame, keys: Sequence[str], cover_iou: float = 0.25) -> DataFrame:
    """Regions that no confirmed track accounts for, stored: the flags and the drawn regions both read them."""
    return stored_table(overlap.unexplained(rois, track_box(tracks.where("confirmed")), list(keys), ["roi_no"], cover_iou))


def frame_flags(
    frames: DataFrame, rois: DataFrame, tracks: DataFrame, keys: Sequence[str], refresh_age: int = 8, cover_iou: float = 0.25,
    loose: DataFrame | None = None,
) -> DataFrame:
    """Per frame: has regions, unexplained motion, confirmed, pending and stale tracks.

    `loose` holds the unexplained regions if `loose_regions` has found them already.
    """
    keys = list(keys)
    per = tracks.groupBy(*keys).agg(
        F.bool_or("confirmed").alias("confirmed"),
        F.bool_or(~F.col("confirmed") & (F.col("hits") >= 1)).alias("pending"),
        F.bool_or(F.col("confirmed") & (F.col("time_since_update") >= refresh_age)).alias("stale"),
    )
    if loose is None:
        loose = overlap.unexplained(rois, track_box(tracks.where("confirmed")), keys, ["roi_no"], cover_iou)
    seen = rois.groupBy(*keys).agg(F.lit(True).alias("has_rois"))
    odd = loose.groupBy(*keys).agg(F.lit(True).alias("unexplained"))
    joined = frames.join(per, keys, "left").join(seen, keys, "left").join(odd, keys, "left")
    flags = ["confirmed", "pending", "stale", "has_rois", "unexplained"]
    return joined.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def _next(state: Column, kind: Column, every: int) -> Column:
    """Frames since the last run, capped at `every`; kind 2 always runs, 1 runs when due."""
    grown = F.least(state + 1, F.lit(every))
    return F.when((kind == 2) | ((kind == 1) & (grown >= every)), F.lit(0)).otherwise(grown)


def _fold_map(kinds: Column, every: int) -> Column:
    """End state for every possible start state, over an array of kinds."""
    start = F.sequence(F.lit(0), F.lit(every))
    return F.aggregate(kinds, start, lambda m, k: F.transform(m, lambda s: _next(s, k, every)))


def _starts(maps: DataFrame, keys: list[str], every: int, count: int) -> DataFrame:
    """State at the start of each block, from ``keys, idx, map``; long lists go up a level."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "map")))
    if count <= BLOCK:
        lists = maps.groupBy(*keys).agg(rows.alias("_rows")).withColumn("_s", F.lit(every))
    else:
        wide = maps.withColumn("_up", F.floor(F.col("idx") / BLOCK).cast("bigint"))
        lists = wide.groupBy(*keys, "_up").agg(rows.alias("_rows"))
        chained = F.aggregate(
            "_rows", F.sequence(F.lit(0), F.lit(every)), lambda m, r: F.transform(m, lambda s: F.get(r["map"], s))
        )
        upper = lists.select(*keys, F.col("_up").alias("idx"), chained.alias("map"))
        above = _starts(upper, keys, every, -(-count // BLOCK)).withColumnRenamed("idx", "_up").withColumnRenamed("start", "_s")
        lists = lists.join(above, [*keys, "_up"])
    zero = F.struct(F.col("_s").alias("s"), F.array().cast("array<struct<idx:bigint,start:int>>").alias("out"))
    walked = F.aggregate(
        "_rows", zero,
        lambda a, r: F.struct(
            F.get(r["map"], a["s"]).alias("s"),
            F.concat(a["out"], F.array(F.struct(r["idx"].alias("idx"), a["s"].alias("start")))).alias("out"),
        ),
    )
    # no list is empty; a plain explode would compute it once more to filter by its size
    return lists.select(*keys, F.explode_outer(walked["out"]).alias("_o")).select(*keys, "_o.idx", "_o.start")


def decide(
    flags: DataFrame,
    stream_keys: Sequence[str],
    order: str,
    detect_every: int = 5,
    enabled: bool = True,
    use_tracker: bool = True,
    **options,
) -> DataFrame:
    """Adds `run`, `reason` and `duty_frac` to each frame.

    Only one rule depends on the past: a live stream is refreshed when it has been
    `detect_every` frames since the last run. That counter has few values, so a block
    of frames is summarised by where each value ends up; block summaries are chained
    and every block is replayed from its true start, wherever a stream's frames are.
    """
    keys = list(stream_keys)
    trig = F.col("triggered")
    live = F.col("confirmed") | F.col("pending")
    if not enabled or not use_tracker:
        names = ("legacy-gate", "legacy-idle") if not enabled else ("predict-no-track", "quiet-scene")
        decided = flags.withColumns({"run": trig, "reason": F.when(trig, names[0]).otherwise(names[1])})
    else:
        # one narrow row per frame, read by the fold, the replay and the result
        flags = cut_lineage(flags)
        forced = F.col("unexplained") | (F.col("pending") & trig) | (live & F.col("stale")) | (~live & trig)
        kind = F.when(forced, 2).when(live, 1).otherwise(0)
        placed = running(flags, keys, [order], {"_pos": ("sum", F.lit(1).cast("bigint"), True)}, **options).withColumn("_kind", kind)
        blocks = placed.withColumn("idx", F.floor((F.col("_pos") - 1) / BLOCK).cast("bigint"))
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_kind").alias("k"))))
        lists = stored_table(blocks.groupBy(*keys, "idx").agg(rows.alias("_rows")))  # for the blocks' maps and for the replay
        maps = lists.select(*keys, "idx", _fold_map(F.col("_rows.k"), detect_every).alias("map"))
        longest = largest_group(flags, keys)
        options = {**options, "size": longest}
        count = -(-longest // BLOCK)
        starts = _starts(maps, keys, detect_every, max(1, count))
        order_type = dict(flags.dtypes)[order]
        zero = F.struct(F.col("start").alias("s"), F.array().cast(f"array<struct<o:{order_type},run:boolean>>").alias("out"))

        def replay(a, r):
            after = _next(a["s"], r["k"], detect_every)
            entry = F.struct(r["o"].alias("o"), (after == 0).alias("run"))
            return F.struct(after.alias("s"), F.concat(a["out"], F.array(entry)).alias("out"))

        walked = lists.join(starts, [*keys, "idx"]).select(*keys, F.explode_outer(F.aggregate("_rows", zero, replay)["out"]).alias("_o"))
        runs = walked.select(*keys, F.col("_o.o").alias(order), F.col("_o.run").alias("run"))
        reason = (
            F.when(F.col("unexplained"), "unexplained-motion")
            .when(F.col("pending") & trig, "confirm-pending")
            .when(live & F.col("run"), "keyframe-refresh")
            .when(live, F.when(trig, "coast-tracked").otherwise("coast-quiet"))
            .when(trig, F.when(F.col("has_rois"), "unexplained-motion").otherwise("triggered-full"))
            .otherwise("quiet-scene")
        )
        decided = flags.join(runs, [*keys, order]).withColumn("reason", reason)
    from gridlark.operators.metrics import duty_fraction

    return duty_fraction(decided, keys, [order], "run", **options)


def run_regions(
    decided: DataFrame, rois: DataFrame, tracks: DataFrame, keys: Sequence[str], cover_iou: float = 0.25,
    tiny_frac: float = 0.035, min_side: int = 320, pad: int = 24, loose: DataFrame | None = None,
) -> DataFrame:
    """Regions the detector looks at on each running frame, with the frame's mode.

    Unexplained regions, else all regions or pending tracks, else confirmed or pending
    tracks, by the frame's reason; a running frame without any has mode `full`.
    Frames carry `width` and `height`. `loose` is as in `frame_flags`.
    """
    keys = list(keys)
    runs = cut_lineage(decided.where("run").select(*keys, "reason", "width", "height", "confirmed", "has_rois"))
    whole = [F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    if loose is None:
        loose = overlap.unexplained(rois, track_box(tracks.where("confirmed")), keys, ["roi_no"], cover_iou)
    loose = loose.select(*keys, *whole)
    drawn = rois.select(*keys, *whole)
    padded = B.pad_roi(B.box(), pad, "width", "height")
    boxes = track_box(tracks.withColumnRenamed("confirmed", "_sure")).join(runs, keys).withColumns(dict(zip(("x1", "y1", "x2", "y2"), padded)))
    # pending tracks and tracks to refresh
    tracked = boxes.where(
        "(reason = 'confirm-pending' AND NOT has_rois AND NOT _sure AND hits >= 1)"
        " OR (reason = 'keyframe-refresh' AND (_sure OR (NOT confirmed AND hits >= 1)))"
    )
    pick = lambda df: df.select(*keys, "width", "height", "reason", "x1", "y1", "x2", "y2")
    first = pick(loose.join(runs.where("reason = 'unexplained-motion'"), keys))
    second = pick(drawn.join(runs.where("reason IN ('confirm-pending', 'predict-no-track', 'legacy-gate')"), keys))
    # read for the frame's mode and for the windows
    looks = stored_table(first.unionByName(second).unionByName(pick(tracked)))
    planned = crop_plan(looks, keys, tiny_frac, min_side, pad).select(*keys, "mode", "x1", "y1", "x2", "y2")
    return runs.select(*keys, "reason").join(planned, keys, "left").withColumn("mode", F.coalesce("mode", F.lit("full")))
