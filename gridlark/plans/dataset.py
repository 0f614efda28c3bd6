"""Dataset preparation: images and label lines to one split, rewritten set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.functions import labels as L
from gridlark.operators.pairing import pair_stems
from gridlark.operators.texts import label_text
from gridlark.session import stored_table


def placed(files: DataFrame) -> DataFrame:
    """`files` with ``root, sub, stem``: the folder above `images` or `labels`, the folders
    below it and the file's name."""
    path = F.col("path")
    return files.withColumns(
        {
            "root": F.regexp_extract(path, r"^(.*?)/?(?:images|labels)/", 1),
            "sub": F.regexp_extract(path, r"(?:^|/)(?:images|labels)/(?:(.*)/)?[^/]*$", 1),
            "stem": L.file_stem(path),
        }
    )


def prepare(
    images: DataFrame,
    lines: DataFrame,
    prefix: str,
    class_map: dict[int, int],
    default_cls: int | None = None,
    keep_empty: bool = True,
) -> DataFrame:
    """``images(path)`` and ``lines(path, line_no, line)`` to one row per image.

    Label files are found by folder and name, so equal names in two folders keep their
    own lines. Classes are rewritten, lines gathered per file, the split taken from the
    folder and the name prefixed; where names still clash within a split, the later paths
    get a number. Images without any label file are kept unless `keep_empty` is off.
    """
    rewritten = lines.withColumn("line", L.rewrite_label(F.col("line"), class_map, default_cls))
    # a row per label file, kept lines or not: read for the lookup and for the texts
    texts = stored_table(label_text(rewritten, ["path"], "line_no", "line").withColumnRenamed("path", "label_path"))
    found = pair_stems(placed(images.select("path")), placed(texts.select(F.col("label_path").alias("path"))))
    joined = found.withColumn("split", L.split_of_folder(F.col("path"))).join(texts, "label_path", "left")
    if not keep_empty:
        joined = joined.where(F.col("text").isNotNull())
    again = F.row_number().over(W.partitionBy("split", "stem").orderBy("path"))
    joined = joined.withColumn("_again", again)
    name = F.concat_ws("_", F.lit(prefix), "stem", F.when(F.col("_again") > 1, F.col("_again").cast("string")))
    return joined.select(
        "split",
        name.alias("stem"),
        F.coalesce("kept", F.lit(0).cast("bigint")).alias("kept"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
