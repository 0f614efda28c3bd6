"""Column helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.session import cut_lineage

#: A word is a longest run of characters other than space and tab to carriage return.
WORD_BREAKS = "[\\x20\\x09-\\x0D]+"
BREAK_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAKS), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or a longer name where the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def broadcast_if_small(stored: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A stored narrow table, marked for broadcast if a count proves it small."""
    return F.broadcast(stored) if stored.count() <= most_rows else stored


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, size: str | None = None) -> DataFrame:
    """Adds the row's number from 0 in its group, and the group's size if asked for.

    Null groups are groups; nulls come first in the order. The rows are sorted by range
    and stored, so a group of any size spreads over tasks; only counts per task and group
    are summed up in a window.
    """
    part, at, first, before, n = (free_name(df, c) for c in ("_part", "_pos", "_first", "_before", "_count"))
    sort = [*group, *order]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    stored = cut_lineage(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}))
    runs = stored.groupBy(part, *group).agg(F.min(at).alias(first), F.count("*").alias(n))
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    earlier = whole.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumns({before: F.coalesce(F.sum(n).over(earlier), F.lit(0)), n: F.sum(n).over(whole)})
    runs = broadcast_if_small(cut_lineage(runs))
    same = [stored[part] == runs[part], *[stored[c].eqNullSafe(runs[c]) for c in group]]
    both = stored.join(runs, reduce(lambda a, b: a & b, same))
    more = [(F.col(at) - F.col(first) + F.col(before)).alias(name)] + ([F.col(n).alias(size)] if size else [])
    return both.select(*[stored[c] for c in df.columns], *more)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text of ASCII characters."""
    step = lambda x: f"CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END"
    byte = "list_reduce([xor(c, b) % 256, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: " + step("x") + ")"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor({byte}, c // 256)), 4294967295)"
