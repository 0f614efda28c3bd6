"""Consensus labelling: boxes of several models to split label files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.operators.fusion import fuse_boxes
from gridlark.operators.remap import remap_classes
from gridlark.operators.sampling import shuffle_split
from gridlark.sources.sinks import label_files


def consensus_labels(
    images: DataFrame,
    model_boxes: DataFrame,
    class_map: DataFrame,
    weights: Sequence[float],
    ratios: tuple[float, float, float] = (0.8, 0.15, 0.05),
    seed: int = 42,
    iou_thr: float = 0.55,
    skip_thr: float = 0.35,
) -> DataFrame:
    """``image_id, split, n_labels, text`` for every image.

    ``images(image_id, width, height)``; `model_boxes` holds pixel boxes with
    `source_idx`, `class_id` and `conf`; ``class_map(source_idx, raw, target)`` renames
    classes and drops the rest.
    """
    known = remap_classes(model_boxes, class_map, source_key="source_idx")
    sized = known.join(images.select("image_id", "width", "height"), "image_id")
    unit = sized.withColumns(dict(zip(("x1", "y1", "x2", "y2"), B.normalise(B.box(), "width", "height"))))
    fused = fuse_boxes(unit, ["image_id"], weights, iou_thr, skip_thr)
    # strongest first, with the place as tie-break, as the order of lines in a file
    ranked = fused.withColumn("_order", F.struct((-F.col("confidence")).alias("k"), "class_id", "x1", "y1"))
    split = shuffle_split(images.select("image_id"), "image_id", *ratios, seed=seed)
    files = label_files(split, ranked, "image_id", "_order")
    return files.select("image_id", "split", F.col("kept").alias("n_labels"), "text")
