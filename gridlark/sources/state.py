"""Job state kept as tables: finished work, merged settings and source outcomes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def skip_done(work: DataFrame, done: DataFrame, ref: str = "ref", tag: str = "tag") -> DataFrame:
    """Work whose ref and tag are both absent from the finished refs."""
    seen = done.select(F.col(ref).cast("string").alias("_done")).distinct()
    first = work.join(seen, F.col(ref).cast("string") == F.col("_done"), "left_anti")
    return first.join(seen, F.col(tag).cast("string") == F.col("_done"), "left_anti")


def mark_done(refs: DataFrame, path: str) -> None:
    """Append finished refs once their work is written."""
    refs.write.mode("append").parquet(path)


def merge_state(stored: DataFrame, update: DataFrame) -> DataFrame:
    """Last writer wins per key; both have ``key, value, version``."""
    both = stored.unionByName(update)
    return both.groupBy("key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))


def source_status(
    spark: SparkSession, wanted: Sequence[str], loaders: dict[str, Callable[[], DataFrame]]
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Load each wanted source; unknown names and failures are recorded and skipped.

    The status has one row per wanted name: its image count, or what went wrong.
    """
    rows, loaded = [], {}
    for name in wanted:
        load = loaders.get(name)
        if load is None:
            rows.append((name, "UNKNOWN_SOURCE", None))
            continue
        try:
            df = load()
            rows.append((name, "OK", df.count()))
            loaded[name] = df
        except Exception as exc:  # noqa: BLE001 - one bad source must not stop the others
            rows.append((name, f"FAILED {type(exc).__name__}", None))
    return spark.createDataFrame(rows, "source string, status string, images bigint"), loaded
