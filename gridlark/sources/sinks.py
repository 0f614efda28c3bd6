"""Frame logs, label files and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions import labels as L
from gridlark.operators.texts import label_text


def frame_log(
    frames: DataFrame, detections: DataFrame, tracks: DataFrame, keys: Sequence[str], det_order: str, track_order: str
) -> DataFrame:
    """One nested record per frame: ``gate``, ``duty``, ordered detections and tracks.

    The record holds its frame's boxes by definition, so only finished output rows are
    gathered; both child tables are grouped once on the frame key before the join.
    """
    keys = list(keys)
    det_cols = [c for c in detections.columns if c not in keys]
    trk_cols = [c for c in tracks.columns if c not in keys]

    def gathered(df, order, cols, name):
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*cols).alias("_v"))))
        return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["_v"]).alias(name))

    out = frames.join(gathered(detections, det_order, det_cols, "detections"), keys, "left")
    out = out.join(gathered(tracks, track_order, trk_cols, "tracks"), keys, "left")
    return out.withColumns({n: F.coalesce(n, F.array()) for n in ("detections", "tracks")})


def write_frame_log(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").json(path)


def label_files(images: DataFrame, boxes: DataFrame, image: str, order: str) -> DataFrame:
    """``image, kept, text`` for every image: its number of lines and the lines; none gives an empty text."""
    line = L.format_box(F.col("class_id"), F.col("xc"), F.col("yc"), F.col("bw"), F.col("bh"))
    texts = label_text(boxes.withColumn("line", line), [image], order, "line")
    none = {"text": F.coalesce("text", F.lit("")), "kept": F.coalesce("kept", F.lit(0).cast("bigint"))}
    return images.join(texts, image, "left").withColumns(none)


def write_label_files(files: DataFrame, path: str, image: str) -> None:
    """Label texts as rows ``(image, text)`` in one folder per split.

    A folder or file per image does not scale to many millions of images; an empty text
    stays a row with an empty text.
    """
    files.select("split", image, "text").write.mode("overwrite").partitionBy("split").parquet(path)


def manifest(names: DataFrame, path: str, splits: Sequence[str]) -> DataFrame:
    """One row: path, split folders, class count and the id -> name map."""
    entries = F.array_sort(F.collect_list(F.struct("id", "name")))
    return names.agg(F.map_from_entries(entries).alias("names"), F.count("*").alias("nc")).select(
        F.lit(path).alias("path"), *[F.lit(f"images/{s}").alias(s) for s in splits], "nc", "names"
    )


def write_manifest(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)
