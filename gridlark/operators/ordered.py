"""Exact running values over ordered groups that may be very large.

A window sorts and walks each group in one task. That is the right plan while
groups are small. When one group holds a large share of the table, its rows are
cut into ordered slices, each slice is windowed on its own, and the totals of
the earlier slices are carried in. Both ways give the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.session import cut_lineage

HOT_ROWS = 2_000_000
#: Beyond this many slices, slices grow instead; each is sorted by one task, which may spill.
MOST_SLICES = 4096


def largest_group(df: DataFrame, part: Sequence[str]) -> int:
    """Size of the biggest group now; one narrow scan.

    It only chooses between plans that give the same rows: a table may have grown by the
    time the plan runs.
    """
    if not part:
        return df.count()
    row = df.groupBy(*part).count().agg(F.max("count")).first()
    return int(row[0] or 0)


_COMBINE = {
    "sum": lambda carry, own: F.when(carry.isNull(), own).otherwise(F.when(own.isNull(), carry).otherwise(carry + own)),
    "max": lambda carry, own: F.greatest(carry, own),
    "min": lambda carry, own: F.least(carry, own),
    "last": lambda carry, own: F.coalesce(own, carry),
}
_WINDOW = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _frame(window, inclusive: bool):
    return window.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)


def _windowed(df: DataFrame, part: list[str], order: list[str], specs: dict[str, tuple]) -> DataFrame:
    base = (W.partitionBy(*part) if part else W.partitionBy()).orderBy(*order)
    return df.withColumns({n: _WINDOW[kind](expr).over(_frame(base, inc)) for n, (kind, expr, inc) in specs.items()})


def running(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple],
    hot_rows: int = HOT_ROWS,
    size: int | None = None,
) -> DataFrame:
    """Add running columns: ``specs[name] = (kind, column, inclusive)``.

    `kind` is sum, max, min or last (last non-null value). Exclusive columns see
    only the rows before the current one. `order` must be a total order. `size` is
    a known bound on the group size, which saves the look-up.
    """
    part, order = list(part), list(order)
    if size is None or size > hot_rows:
        size = largest_group(df, part)

    if size <= hot_rows:
        return _windowed(df, part, order, specs)
    line = [*part, *order]
    if part:
        # fewer than rows / hot_rows groups can pass this filter, so the table is small
        hot = df.groupBy(*part).count().where(F.col("count") > hot_rows)
        hot = cut_lineage(hot.toDF(*[f"_h_{c}" for c in part], "_h"))
        total = hot.agg(F.sum("_h")).first()[0] or 0
        match = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in part]
        cold, large = (df.join(F.broadcast(hot), match, how) for how in ("left_anti", "left_semi"))
        done = _windowed(cold, part, order, specs)
    else:
        total, large, done = size, df, None
    # the sort's own sample finds the bounds; a slice is a task of it
    pieces = min(MOST_SLICES, max(2, 4 * (total // hot_rows + 1)))
    ranged = large.repartitionByRange(pieces, *line)
    marked = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))

    order_key = F.struct(*order)
    totals = marked.groupBy(*part, "_slice").agg(
        *[
            (
                F.max_by(expr, F.when(expr.isNotNull(), order_key))
                if kind == "last"
                else _WINDOW[kind](expr)
            ).alias(f"_t_{n}")
            for n, (kind, expr, _) in specs.items()
        ]
    )
    # slices run through the groups in order, so there are at most pieces + hot groups of these
    before = (W.partitionBy(*part) if part else W.partitionBy()).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(c).alias(f"_h_{c}") for c in (*part, "_slice")],
        *[_WINDOW[kind](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (kind, _, _) in specs.items()],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in (*part, "_slice")]
    keyed = marked.join(F.broadcast(carried), same, "left")
    inner = W.partitionBy(*part, "_slice").orderBy(*order)
    out = keyed.withColumns(
        {
            n: _COMBINE[kind](F.col(f"_c_{n}"), _WINDOW[kind](expr).over(_frame(inner, inc)))
            for n, (kind, expr, inc) in specs.items()
        }
    ).select(*df.columns, *specs)
    return out if done is None else done.select(*df.columns, *specs).union(out)


def number_rows(
    df: DataFrame, part: Sequence[str], order: Sequence[str], name: str, hot_rows: int = HOT_ROWS, size: int | None = None
) -> DataFrame:
    """1-based row number inside each group of `part` (all rows when empty)."""
    return running(df, part, order, {name: ("sum", F.lit(1).cast("bigint"), True)}, hot_rows, size)


def islands(
    df: DataFrame,
    part: Sequence[str],
    lo: str,
    hi: str,
    ties: Sequence[str],
    name: str,
    hot_rows: int = HOT_ROWS,
    size: int | None = None,
) -> DataFrame:
    """Id of the island each interval ``[lo, hi]`` belongs to.

    Intervals are chained while the next one starts at or before the furthest end
    so far; the id is the start of the island's first interval.
    """
    if size is None:
        size = largest_group(df, part)
    reach = running(df, part, [lo, *ties], {"_reach": ("max", F.col(hi), False)}, hot_rows, size)
    starts = F.when(F.col("_reach").isNull() | (F.col(lo) > F.col("_reach")), F.col(lo))
    return running(reach, part, [lo, *ties], {name: ("last", starts, True)}, hot_rows, size).drop("_reach")
