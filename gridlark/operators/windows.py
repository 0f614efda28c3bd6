"""Region planning: crops, tiles and region-to-detection projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions import boxes as B


def crop_plan(
    rois: DataFrame, frame_keys: Sequence[str], tiny_frac: float = 0.035, min_side: int = 320, pad: int = 24
) -> DataFrame:
    """Tiny regions become square tiles, others are clipped; one tile makes the frame's mode `tile`.

    The per-frame flag is a small partial aggregate joined back, so a frame with
    very many regions is not gathered anywhere.
    """
    clipped = B.clip(B.box(), "width", "height")
    base = rois.withColumns(dict(zip(("x1", "y1", "x2", "y2"), clipped)))
    base = base.withColumn("_tiny", B.is_tiny(B.box(), "width", "height", tiny_frac))
    tile = B.expand_tile(B.box(), "width", "height", min_side, pad)
    mode = base.groupBy(*frame_keys).agg(F.when(F.bool_or("_tiny"), "tile").otherwise("crop").alias("mode"))
    planned = base.withColumns(
        {n: F.when(F.col("_tiny"), v).otherwise(F.col(n)) for n, v in zip(("x1", "y1", "x2", "y2"), tile)}
    )
    return planned.join(mode, list(frame_keys)).drop("_tiny")


def roi_to_detection(rois: DataFrame, ordinal: str, name: str = "object") -> DataFrame:
    """Stand-in scorer: each region is a detection at confidence 0.6."""
    clipped = B.clip(B.box(), "width", "height")
    return rois.withColumns(
        {
            **{n: v.cast("double") for n, v in zip(("x1", "y1", "x2", "y2"), clipped)},
            "class_id": F.col(ordinal).cast("int"),
            "class_name": F.lit(name),
            "conf": F.lit(0.6),
        }
    )
