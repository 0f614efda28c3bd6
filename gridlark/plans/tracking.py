"""Recorded run: detections of every frame to published tracks and a frame log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.operators.tracker import TrackerOptions, track_multi
from gridlark.operators.tracks import publish
from gridlark.sources.sinks import frame_log

KEYS = ["stream_id", "frame_index"]


def track_log(
    frames: DataFrame,
    detections: DataFrame,
    points: DataFrame | None = None,
    fps: float = 30.0,
    options: TrackerOptions | None = None,
    max_coast: int = 12,
) -> DataFrame:
    """One nested record per frame; extra columns of `frames` (gate, duty) pass through."""
    states = track_multi(frames.select(*KEYS), detections, ["stream_id"], points, options)
    shown = publish(states, max_coast=max_coast)
    slim = shown.select(
        *KEYS, "track_id", F.array(F.col("x") - F.col("w") * 0.5, F.col("y") - F.col("h") * 0.5, F.col("x") + F.col("w") * 0.5, F.col("y") + F.col("h") * 0.5).alias("bbox"),
        F.array("x", "y").alias("xy"), F.array("vx", "vy").alias("v"), "class_name", "name", "confirmed",
    )
    det = detections.select(*KEYS, "det_no", F.array("x1", "y1", "x2", "y2").alias("bbox"), "conf")
    timed = frames.withColumn("timestamp", F.col("frame_index") / F.lit(float(fps)))
    return frame_log(timed, det, slim, KEYS, "det_no", "track_id")
