"""Class ids: table-driven remapping and class-name lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Maps of at most this many rows are broadcast.
SMALL_MAP = 100_000


def _lookup(table: DataFrame) -> DataFrame:
    """The map, marked for broadcast if a count proves it small.

    Spark does not know the size of rows made in the driver. It would then shuffle the
    boxes by class, so that all boxes of a class meet in one task.
    """
    return F.broadcast(table) if table.limit(SMALL_MAP + 1).count() <= SMALL_MAP else table


def remap_classes(
    boxes: DataFrame,
    class_map: DataFrame,
    policy: str = "drop",
    default_cls: int | None = None,
    source_key: str | None = None,
    raw: str = "class_id",
) -> DataFrame:
    """Replace `raw` using ``class_map(raw, target[, source])``.

    `class_map.raw` may hold whole numbers or text; a whole-number match wins over
    the same number as text. A row whose target is NULL always drops. Unmapped ids
    follow `policy`: drop, default or keep. A small map is broadcast.
    """
    if policy not in ("drop", "default", "keep"):
        raise ValueError(f"unknown policy {policy}")
    keys = [source_key] if source_key else []
    is_text = dict(class_map.dtypes)["raw"] == "string"
    lookup = class_map.select(*keys, F.col("raw").cast("string").alias("_raw"), F.col("target").cast("int").alias("_target"))
    if is_text:
        # '1' and '01' are different texts; only the plain form of the number matches
        lookup = lookup.dropDuplicates([*keys, "_raw"])
    keyed = boxes.withColumn("_raw", F.col(raw).cast("string"))
    joined = keyed.join(_lookup(lookup.withColumn("_known", F.lit(True))), [*keys, "_raw"], "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    if policy == "drop":
        target = F.col("_target")
    elif policy == "default":
        target = F.when(known, F.col("_target")).otherwise(F.lit(default_cls).cast("int"))
    else:
        target = F.when(known, F.col("_target")).otherwise(F.col(raw))
    return joined.withColumn(raw, target.cast("int")).where(F.col(raw).isNotNull()).drop("_raw", "_target", "_known")


def attach_class(boxes: DataFrame, mids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Machine id -> class name -> class id; boxes outside the vocabulary drop."""
    return boxes.join(_lookup(mids), "mid").join(_lookup(vocabulary), "class_name")


def ordered_names(names: DataFrame) -> DataFrame:
    """Class names in the order of their whole-number keys, re-numbered from 0."""
    from gridlark.operators.ordered import number_rows

    keyed = names.withColumn("_key", F.col("key").cast("bigint"))
    return number_rows(keyed, [], ["_key"], "_n").select((F.col("_n") - 1).cast("int").alias("id"), "name")
