"""Tile windows of large images and boxes carried into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(side: Column, tile: int, step: int) -> Column:
    """Window starts along one axis, the last one flush with the edge."""
    span = F.greatest(F.lit(1), side - tile)
    regular = F.sequence(F.lit(0), span - 1, F.lit(step))
    last = F.floor((span - 1) / step).cast("int") * step
    return F.when(last + tile < side, F.array_union(regular, F.array(F.greatest(F.lit(0), side - tile)))).otherwise(regular)


def _step(tile: int, overlap: float, min_step: int) -> int:
    return max(min_step, int(tile * (1.0 - overlap)))


def tile_grid(images: DataFrame, tile: int = 640, overlap: float = 0.2, min_step: int = 1) -> DataFrame:
    """One row per tile window; an image that fits is one row with `whole` set."""
    step = _step(tile, overlap, min_step)
    w, h = F.col("width"), F.col("height")
    grid = images.withColumn("_x", F.explode(_starts(w, tile, step))).withColumn("_y", F.explode(_starts(h, tile, step)))
    x2, y2 = F.least(w, F.col("_x") + tile), F.least(h, F.col("_y") + tile)
    return grid.withColumns(
        {
            "tx2": x2, "ty2": y2,
            "tx1": F.greatest(F.lit(0), x2 - tile), "ty1": F.greatest(F.lit(0), y2 - tile),
            "whole": (w <= tile) & (h <= tile),
        }
    ).drop("_x", "_y")


def tile_name(stem: Column) -> Column:
    return F.when(F.col("whole"), stem).otherwise(F.format_string("%s_tile_%d_%d", stem, "ty1", "tx1"))


def tile_project(
    images: DataFrame,
    boxes: DataFrame,
    tile: int = 640,
    overlap: float = 0.2,
    visible: float = 0.3,
    min_side: float = 0.005,
    fixed: bool = False,
    min_step: int = 1,
) -> DataFrame:
    """Carry frame-share boxes (xc, yc, bw, bh) into every tile that shows enough of them.

    The image size is joined to the boxes once and the tile windows of each box's own
    image are generated in place, so no tile table is shuffled and the cost of a box
    is its own image's tile count. With ``fixed=True`` shares are taken of the nominal
    tile size, the area floor is one pixel and short sides are kept.
    """
    sized = boxes.join(images.select("image_id", "width", "height"), "image_id")
    w, h = F.col("width"), F.col("height")
    pixels = sized.withColumns(
        {
            "_x1": (F.col("xc") - F.col("bw") / 2.0) * w, "_y1": (F.col("yc") - F.col("bh") / 2.0) * h,
            "_x2": (F.col("xc") + F.col("bw") / 2.0) * w, "_y2": (F.col("yc") + F.col("bh") / 2.0) * h,
        }
    )
    cut = tile_grid(pixels, tile, overlap, min_step).withColumns(
        {
            "_ix1": F.greatest("_x1", F.col("tx1").cast("double")), "_iy1": F.greatest("_y1", F.col("ty1").cast("double")),
            "_ix2": F.least("_x2", F.col("tx2").cast("double")), "_iy2": F.least("_y2", F.col("ty2").cast("double")),
        }
    )
    ix1, iy1, ix2, iy2 = (F.col(c) for c in ("_ix1", "_iy1", "_ix2", "_iy2"))
    zero = F.lit(0.0)
    inter = F.greatest(zero, ix2 - ix1) * F.greatest(zero, iy2 - iy1)
    bw, bh = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    if fixed:
        keep = (ix2 > ix1) & (iy2 > iy1) & (inter / F.greatest(F.lit(1.0), bw * bh) >= visible)
        tw = th = F.lit(float(tile))
    else:
        orig = F.greatest(zero, bw) * F.greatest(zero, bh)
        keep = (orig > 0) & (inter / F.when(orig > 0, orig) >= visible)
        tw = (F.col("tx2") - F.col("tx1")).cast("double")
        th = (F.col("ty2") - F.col("ty1")).cast("double")
    shown = cut.where(F.col("whole") | keep)
    whole = F.col("whole")
    out = shown.withColumns(
        {
            "xc": F.when(whole, F.col("xc")).otherwise(((ix1 + ix2) / 2.0 - F.col("tx1")) / tw),
            "yc": F.when(whole, F.col("yc")).otherwise(((iy1 + iy2) / 2.0 - F.col("ty1")) / th),
            "bw": F.when(whole, F.col("bw")).otherwise((ix2 - ix1) / tw),
            "bh": F.when(whole, F.col("bh")).otherwise((iy2 - iy1) / th),
        }
    )
    if not fixed:
        out = out.where(whole | ((F.col("bw") > min_side) & (F.col("bh") > min_side)))
    return out.drop("_x1", "_y1", "_x2", "_y2", "_ix1", "_iy1", "_ix2", "_iy2")
