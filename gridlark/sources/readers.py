"""Readers for images, label text, CSV boxes, frame sequences and class names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def list_images(spark: SparkSession, folder: str, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Every image below a folder: path, size and time, without reading the bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return pick_images(files.select("path", "length", "modificationTime"), suffixes)


def pick_images(files: DataFrame, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(suffix.isin(list(suffixes))).dropDuplicates(["path"])


def read_label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``path, line`` of every label file; undecodable bytes are replaced, not fatal."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_csv_boxes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    return typed_csv_boxes(raw)


def typed_csv_boxes(raw: DataFrame) -> DataFrame:
    """Text columns ImageID, LabelName, XMin, XMax, YMin, YMax to centre boxes; bad rows drop."""
    n = lambda c: F.col(c).try_cast("double")
    x1, x2, y1, y2 = n("XMin"), n("XMax"), n("YMin"), n("YMax")
    boxes = raw.select(
        F.col("ImageID").alias("image_id"), F.col("LabelName").alias("mid"),
        ((x1 + x2) / 2.0).alias("xc"), ((y1 + y2) / 2.0).alias("yc"),
        F.greatest(F.lit(0.0), x2 - x1).alias("w"), F.greatest(F.lit(0.0), y2 - y1).alias("h"),
        (x1.isNotNull() & x2.isNotNull() & y1.isNotNull() & y2.isNotNull()).alias("_ok"),
    )
    return boxes.where(F.col("_ok") & (F.col("w") > 0) & (F.col("h") > 0)).drop("_ok")


def csv_columns(lines: DataFrame, line: str, names: Sequence[str]) -> DataFrame:
    """Lines of CSV text to text columns, parsed once per line."""
    parsed = F.from_csv(F.col(line), ", ".join(f"{n} string" for n in names), {"mode": "PERMISSIVE"})
    return lines.select(F.explode(F.array(parsed)).alias("_r")).select("_r.*")


def read_class_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless two-column file: machine id and class name."""
    return spark.read.schema("mid string, class_name string").csv(path).where("mid IS NOT NULL AND class_name IS NOT NULL")


def sequence_frames(files: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Frames of a folder in name order, numbered from 0."""
    from gridlark.operators.ordered import number_rows

    return number_rows(files, keys, ["name"], "_n", **options).withColumn("frame_index", F.col("_n") - 1).drop("_n")


def folder_sizes(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total size in GiB from a ``length`` column, as `binaryFile` gives it."""
    return files.groupBy(*keys).agg((F.sum("length") / F.lit(float(1 << 30))).alias("gb"), F.count("*").alias("files"))
