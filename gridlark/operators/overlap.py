"""Spatial joins of boxes that share a frame.

Boxes are assigned to the square grid cells they touch and joined on
(frame, cell). A crowded frame is thereby spread over many keys and only boxes
that lie near each other are compared. There are grids of growing cell size: a box
belongs to the finest one whose cells are as long as the box, so it touches four
cells at most, and a pair meets on the coarser grid of its two boxes. A pair is kept
in one cell only, the one holding the near corner of the intersection, so no
duplicate removal is needed. While no frame holds more than a few boxes, the frame
alone is the key, and no box is written more than once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.operators.ordered import largest_group

#: Frames with at most this many boxes a side are compared box by box.
SMALL_FRAME = 32


def confidence_bands(det: DataFrame, low: float, high: float) -> DataFrame:
    kept = det.where(F.col("conf") >= low)
    return kept.withColumn("band", F.when(F.col("conf") >= high, "high").otherwise("low"))


def _level(b) -> Column:
    """Number of the finest grid, of cell side ``4 ** level``, for the box."""
    side = F.greatest(b[2] - b[0], b[3] - b[1])
    return F.when(side > 0, F.ceil(F.log(4.0, side.cast("double"))).cast("int"))


def levels_of(df: DataFrame, prefix: str = "") -> list[int]:
    """Grids that some box belongs to: a few numbers, whatever the input."""
    return sorted(r[0] for r in df.select(_level(B.box(prefix)).alias("l")).distinct().collect() if r[0] is not None)


def on_cells(df: DataFrame, b, others: Sequence[int], prefix: str = "") -> DataFrame:
    """One row per cell the box touches, on its own grid and on the coarser `others`."""
    own, level, cx, cy = (prefix + c for c in ("_own", "_level", "_cx", "_cy"))
    df = df.withColumn(own, _level(b))
    coarser = F.filter(F.array(*[F.lit(v) for v in others]).cast("array<int>"), lambda v: v > F.col(own))
    df = df.where(F.col(own).isNotNull()).withColumn(level, F.explode(F.concat(F.array(own), coarser)))
    side = F.pow(F.lit(4.0), F.col(level))
    cells = lambda lo, hi: F.sequence(F.floor(lo / side).cast("bigint"), F.floor(hi / side).cast("bigint"))
    return df.withColumn(cx, F.explode(cells(b[0], b[2]))).withColumn(cy, F.explode(cells(b[1], b[3])))


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    frame_keys: Sequence[str],
    right_prefix: str = "r_",
    where: Column | None = None,
    small: int = SMALL_FRAME,
) -> DataFrame:
    """All pairs whose boxes share positive area. Right columns get a prefix.

    `where` may name both sides and is applied inside the join. Frames are joined whole
    if none has more than `small` boxes on a side, else through grid cells; both ways
    give the same pairs.
    """
    p = right_prefix
    named = right.select(*[F.col(c).alias(p + c) for c in right.columns])
    a, b = B.box(), B.box(p)
    if all(largest_group(side, frame_keys) <= small for side in ((left,) if left is right else (left, right))):
        # null and empty boxes share area with nothing, whatever greatest and least make of nulls
        whole = [df.where(c[0].isNotNull() & c[1].isNotNull() & (c[2] > c[0]) & (c[3] > c[1])) for df, c in ((left, a), (named, b))]
        cond = B.overlaps(a, b) if where is None else B.overlaps(a, b) & where
        for k in frame_keys:
            cond = (F.col(k) == F.col(p + k)) & cond
        return whole[0].join(whole[1], cond).drop(*[p + k for k in frame_keys])
    mine = levels_of(left)
    theirs = mine if left is right else levels_of(named, p)
    lhs = on_cells(left, a, theirs)
    rhs = on_cells(named, b, mine, p)
    same = [F.col(k) == F.col(p + k) for k in (*frame_keys, "_level", "_cx", "_cy")]
    side = F.pow(F.lit(4.0), F.col("_level"))
    home = (F.floor(F.greatest(a[0], b[0]) / side) == F.col("_cx")) & (F.floor(F.greatest(a[1], b[1]) / side) == F.col("_cy"))
    cond = B.overlaps(a, b) & home & (F.col("_level") == F.greatest("_own", p + "_own"))
    if where is not None:
        cond = cond & where
    for s in same:
        cond = s & cond
    joined = lhs.join(rhs, cond)
    return joined.drop(*[x + c for x in ("", p) for c in ("_own", "_level", "_cx", "_cy")], *[p + k for k in frame_keys])


def self_pairs(det: DataFrame, frame_keys: Sequence[str], ordinal: str) -> DataFrame:
    """Overlapping pairs of boxes of one frame, each pair once, with their IoU."""
    ordered = F.col(ordinal) < F.col("r_" + ordinal)
    pairs = overlap_pairs(det, det, frame_keys, "r_", ordered)
    return pairs.withColumn("iou", B.iou(B.box(), B.box("r_")))


def touching(
    boxes: DataFrame,
    rois: DataFrame,
    frame_keys: Sequence[str],
    row_keys: Sequence[str],
    rule: Column,
) -> DataFrame:
    """Keys of the boxes for which `rule` holds with any overlapping region (prefix r_)."""
    slim = boxes.select(*dict.fromkeys([*frame_keys, *row_keys, "x1", "y1", "x2", "y2"]))
    other = rois.select(*frame_keys, "x1", "y1", "x2", "y2")
    hits = overlap_pairs(slim, other, frame_keys, "r_", rule)
    return hits.select(*dict.fromkeys([*frame_keys, *row_keys])).distinct()


def semi_overlap(
    det: DataFrame,
    rois: DataFrame,
    frame_keys: Sequence[str],
    row_keys: Sequence[str],
    min_share: float = 0.05,
) -> DataFrame:
    """Boxes with at least `min_share` of their area inside some region."""
    rule = B.cover(B.box(), B.box("r_")) >= min_share
    keys = touching(det, rois, frame_keys, row_keys, rule)
    return det.join(keys, list(dict.fromkeys([*frame_keys, *row_keys])), "left_semi")


def unexplained(
    rois: DataFrame,
    tracks: DataFrame,
    frame_keys: Sequence[str],
    row_keys: Sequence[str],
    iou_min: float = 0.25,
) -> DataFrame:
    """Regions that no track box accounts for."""
    rule = B.explained(B.box(), B.box("r_"), iou_min)
    keys = touching(rois, tracks, frame_keys, row_keys, rule)
    return rois.join(keys, list(dict.fromkeys([*frame_keys, *row_keys])), "left_anti")


def unpublished(raw: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw tracks that are not among the published ones."""
    return raw.join(published.select(*keys), list(keys), "left_anti")
