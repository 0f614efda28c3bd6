"""Gathering ordered lines into one text per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_text(lines: DataFrame, file_keys: Sequence[str], order: str, line: str) -> DataFrame:
    """One row per file: number of kept lines and the newline-ended text, '' when none.

    The output itself is one text per file, so a file's lines meet in one row by
    definition; only the (order, line) pairs are carried there.
    """
    kept = F.when(F.col(line).isNotNull(), F.struct(order, line))
    gathered = lines.groupBy(*file_keys).agg(F.array_sort(F.collect_list(kept)).alias("_rows"))
    body = F.array_join(F.col(f"_rows.{line}"), "\n")
    return gathered.select(
        *file_keys,
        F.size("_rows").cast("bigint").alias("kept"),
        F.when(F.size("_rows") > 0, F.concat(body, F.lit("\n"))).otherwise(F.lit("")).alias("text"),
    )
