"""Splits, quotas, chunks, de-duplication and unions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.ordered import largest_group, number_rows, running
from gridlark.session import cut_lineage, drop_table, stored_table


def every_nth(df: DataFrame, index: str, stride: int) -> DataFrame:
    return df.where(F.col(index) % max(1, stride) == 0)


def capped(df: DataFrame, order: Sequence[Column | str], most: int, few: int = 10_000) -> DataFrame:
    """The first `most` rows in order.

    Up to `few` rows are kept per task and merged; more are found by their row number, so
    that they never meet in one task.
    """
    if most <= few:
        return df.orderBy(*order).limit(most)
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = df.withColumns({k: F.col(c) if isinstance(c, str) else c for k, c in zip(keys, order)})
    return number_rows(keyed, [], keys, "_n").where(F.col("_n") <= most).drop("_n", *keys)


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("images"))


def boxes_by_image(boxes: DataFrame, keys: Sequence[str], order: str, text: Column) -> DataFrame:
    """Boxes of an image in order, as one text; the text is the requested output row."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return boxes.groupBy(*keys).agg(F.count("*").alias("n_boxes"), F.array_join(rows.getField("t"), ";").alias("boxes"))


def shuffle_split(df: DataFrame, key: str, train: float, val: float, test: float, seed: int = 42, **options) -> DataFrame:
    """Exact int(n*train) / int(n*val) / rest split in the order of a seeded hash of the key."""
    if abs(train + val + test - 1.0) > 1e-4:
        raise ValueError("split ratios must sum to 1")
    n = df.count()
    n_train, n_val = int(n * train), int(n * val)
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    ranked = number_rows(hashed, [], ["_h", key], "_n", **options)
    split = F.when(F.col("_n") <= n_train, "train").when(F.col("_n") <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_h", "_n")


def modulo_split(df: DataFrame, order: Sequence[str], every: int = 10, **options) -> DataFrame:
    """The first of every `every` rows in order goes to val."""
    ranked = number_rows(df, [], order, "_n", **options)
    return ranked.withColumn("split", F.when((F.col("_n") - 1) % every == 0, "val").otherwise("train")).drop("_n")


def val_fallback(df: DataFrame, order: Sequence[str], every: int = 10) -> DataFrame:
    """If nothing is in val, every n-th train row moves there; rows are never in both."""
    if df.where("split = 'val'").limit(1).count():
        return df
    train = modulo_split(df.where("split = 'train'").drop("split"), order, every)
    return train.unionByName(df.where("split <> 'train'").select(train.columns))


def require_rows(df: DataFrame, least: int, what: str) -> DataFrame:
    """The table, failing at run time when it has fewer than `least` rows."""
    short = F.raise_error(F.lit(f"not enough {what}")).cast("bigint")
    return df.agg(F.count("*").alias("rows")).select(F.when(F.col("rows") >= least, F.col("rows")).otherwise(short).alias("rows"))


def quota_sample(boxes: DataFrame, image: str, cls: str, caps: Sequence[tuple[int, int]]) -> DataFrame:
    """Images per class, in priority order, until the class has its cap.

    Every class of a taken image counts towards its own cap. One pass per class:
    in the pass of c each taken image holds c, so the pass takes the first
    ``cap - count`` remaining images. At most the sum of the caps is ever kept.
    """
    held = cut_lineage(boxes.select(image, cls).distinct())  # read two or three times per class
    taken: DataFrame | None = None
    for c, cap in caps:
        have = 0 if taken is None else held.where(F.col(cls) == c).join(taken, image, "left_semi").count()
        if have >= cap:
            continue
        left = held.where(F.col(cls) == c).select(image)
        if taken is not None:
            left = left.join(taken, image, "left_anti")
        chosen = capped(left, [image], cap - have)
        taken = cut_lineage(chosen if taken is None else taken.unionByName(chosen))
    return taken if taken is not None else held.select(image).limit(0)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key; a mergeable minimum, so a key with many copies shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def round_robin(rows: DataFrame, queue: DataFrame, order: Sequence[str], base: int = 0, **options) -> DataFrame:
    """Hand out queue items in turn, starting at `base` and wrapping."""
    n = queue.count()
    slots = number_rows(queue, [], ["position"], "_q").select((F.col("_q") - 1).alias("slot"), "item")
    ranked = number_rows(rows, [], order, "_n", **options).withColumn("slot", (F.lit(base) + F.col("_n") - 1) % n)
    return ranked.join(slots, "slot").drop("_n")


def staged_union(stages: Sequence[DataFrame], upto: int) -> DataFrame:
    """Sources of all stages up to and including `upto`, tagged with their stage."""
    out = None
    for k, df in enumerate(stages[: upto + 1]):
        tagged = df.withColumn("stage", F.lit(k))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def union_sources(sources: dict[str, DataFrame], stem: str) -> DataFrame:
    """Merge sources, prefixing stems with the source name."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name)).withColumn(stem, F.concat_ws("_", F.lit(name), F.col(stem)))
        out = part if out is None else out.unionByName(part)
    return out


#: Fractional sizes are counted in such parts, so that sums do not depend on their order.
PARTS = 1_000_000


def chunk_by_size(
    items: DataFrame, key: str, order: Sequence[str], size: str, limit: float, block_rows: int = 200_000, fan: int = 16, **options
) -> DataFrame:
    """Pack each group's items in order; a chunk closes with the item that reaches `limit`.

    A chunk that starts after a running total B closes at the first total of at least
    B + limit, so all that passes along the line is the next closing mark. Sums are whole
    numbers: fractional sizes and limits count in millionths; null sizes count as 0 and
    negative ones raise.

    While a chunk is smaller than a block of about `block_rows` items, the line is cut into
    blocks. Each lists, for the items that could close the first chunk inside it, the mark
    it hands on; `fan` neighbours compose to one list of the level above, no longer than
    the first of them, and the entries come back down the same way. Larger chunks are few;
    there every item points to the one that would close the next chunk, and the closing
    items are found by doubling those pointers.
    """
    whole = dict(items.dtypes)[size] in ("tinyint", "smallint", "int", "bigint")
    parts = 1 if whole and float(limit).is_integer() else PARTS
    units = F.coalesce(F.round(F.col(size) * parts) if parts > 1 else F.col(size), F.lit(0)).cast("bigint")
    goal = round(limit * parts)
    if goal <= 0:
        raise ValueError("a chunk needs a positive limit")
    checked = F.when(units < 0, F.raise_error("a size is negative").cast("bigint")).otherwise(units)
    options = {**options, "size": largest_group(items, [key])}
    total = running(items, [key], order, {"_sum": ("sum", checked, True), "_pos": ("sum", F.lit(1).cast("bigint"), True)}, **options)
    placed = stored_table(total)
    slim = placed.select(F.col(key).alias("_key"), "_pos", "_sum")
    n, most = slim.agg(F.count("*"), F.max("_sum")).first()
    mean = max(1.0, placed.agg(F.avg(units)).first()[0] or 1.0)
    if goal <= block_rows * mean:
        closing = _closing_by_blocks(slim, goal, goal * max(1, int(block_rows * mean / goal)), fan)
    else:
        closing = _closing_by_jumps(slim, goal, options)
    ends = closing.select(F.col("_key").alias("_k"), F.col("_pos").alias("_p"), F.lit(1).cast("bigint").alias("_end"))
    marked = placed.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_pos") == F.col("_p")), "left")
    numbered = running(marked, [key], ["_pos"], {"_c": ("sum", F.coalesce("_end", F.lit(0).cast("bigint")), False)}, **options)
    return numbered.select(*items.columns, F.coalesce("_c", F.lit(0).cast("bigint")).alias("chunk"))


def _closing_by_jumps(slim: DataFrame, goal: int, options: dict) -> DataFrame:
    """``(_key, _pos)`` of closing items: pointers from every item to the next, doubled."""
    starts = slim.groupBy("_key").agg(F.lit(0).cast("bigint").alias("_pos"), F.lit(goal).cast("bigint").alias("_sum"))
    asked = slim.withColumn("_sum", F.col("_sum") + goal).unionByName(starts)
    # from the largest total down, the last item passed is the first one that reaches the mark
    line = slim.withColumn("_ask", F.lit(0)).unionByName(asked.withColumn("_ask", F.lit(1)))
    line = line.select("_key", "_pos", "_ask", (-F.col("_sum")).alias("_down"), (-F.col("_pos")).alias("_back"))
    seen = running(line, ["_key"], ["_down", "_ask", "_back"], {"_next": ("last", F.when(F.col("_ask") == 0, F.col("_pos")), True)}, **{**options, "size": 2 * options["size"] + 1})
    jump = stored_table(seen.where("_ask = 1 AND _next IS NOT NULL").select("_key", "_pos", "_next"))
    found = stored_table(jump.where("_pos = 0").select("_key", F.col("_next").alias("_pos")))
    jump = stored_table(jump.where("_pos > 0"))
    known = found.count()

    def follow(rows: DataFrame, at: str) -> DataFrame:
        to = jump.select(F.col("_key").alias("_k"), F.col("_pos").alias("_p"), F.col("_next").alias("_to"))
        return rows.join(to, F.col("_key").eqNullSafe(F.col("_k")) & (F.col(at) == F.col("_p")))

    while True:
        more = found.union(follow(found, "_pos").select("_key", F.col("_to").alias("_pos"))).distinct()
        found, before = stored_table(more), found
        now = found.count()
        drop_table(before)
        if now == known:
            return found
        known = now
        jump, before = stored_table(follow(jump, "_next").select("_key", "_pos", F.col("_to").alias("_next"))), jump
        drop_table(before)


def _composed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One list ``(at, mark)`` for neighbouring blocks: where a mark leaves that enters at or before `at`.

    A mark that no item of the first block reaches closes at the first item of the next,
    so one entry of the second list is enough beside the first list.
    """
    at, mark = lists[0]
    if len(lists) > 1:
        at, mark = np.append(at, lists[1][0][0]), np.append(mark, lists[1][0][0])
        # an entry of its own block keeps its mark; the borrowed one still has to close there
    for own, out in lists[1:]:
        i = np.searchsorted(own, mark, side="left")
        mark = np.where(i < len(own), out[np.minimum(i, len(own) - 1)], mark)
    return at, mark


def _closing_by_blocks(slim: DataFrame, goal: int, width: int, fan: int) -> DataFrame:
    """``(_key, _pos)`` of closing items, by blocks of `width` units and levels of blocks."""
    blocks = slim.withColumn("_block", F.floor(F.col("_sum") / width).cast("bigint"))
    kind = dict(slim.dtypes)["_key"]
    listed = f"_key {kind}, _block bigint, _at array<bigint>, _mark array<bigint>"

    def same(pdf: pd.DataFrame, n: int = 1) -> pd.Series:
        v = pdf["_key"].iloc[0]
        return pd.Series([None if pd.isna(v) else v] * n, dtype=object)

    def hand_over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        totals = pdf["_sum"].to_numpy(np.int64)
        n = len(totals)
        nxt = np.append(np.searchsorted(totals, totals + goal, side="left"), n)
        last = np.arange(n + 1)
        # double the reach until every start has arrived at its last closing item here
        while not ((ahead := nxt[last]) >= n).all():
            last = np.where(ahead < n, last[np.minimum(ahead, n)], last)
        starts = np.flatnonzero(totals < pdf["_block"].iloc[0] * width + goal)
        starts = np.append(starts, starts[-1] + 1 if len(starts) else 0)
        starts = starts[starts < n]
        return pd.DataFrame({"_key": same(pdf), "_block": [pdf["_block"].iloc[0]], "_at": [totals[starts]], "_mark": [totals[last[starts]] + goal]})

    def sorted_lists(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values("_block")

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = sorted_lists(pdf)
        at, mark = _composed([(np.asarray(a), np.asarray(m)) for a, m in zip(pdf["_at"], pdf["_mark"])])
        return pd.DataFrame({"_key": same(pdf), "_block": [pdf["_g"].iloc[0]], "_at": [at], "_mark": [mark]})

    levels = [stored_table(blocks.groupBy("_key", "_block").applyInPandas(hand_over, listed))]
    while (levels[-1].agg(F.max("_block")).first()[0] or 0) > 0:
        above = levels[-1].withColumn("_g", F.floor(F.col("_block") / fan).cast("bigint"))
        levels.append(stored_table(above.groupBy("_key", "_g").applyInPandas(up, listed)))

    entered = levels[-1].select("_key", "_block", F.lit(goal).cast("bigint").alias("_enter"))
    for lists in reversed(levels[:-1]):

        def down(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = sorted_lists(pdf)
            mark, out = int(pdf["_enter"].iloc[0]), []
            for at, marks in zip(pdf["_at"], pdf["_mark"]):
                out.append(mark)
                i = int(np.searchsorted(at, mark, side="left"))
                mark = int(marks[i]) if i < len(at) else mark
            return pd.DataFrame({"_key": same(pdf, len(out)), "_block": pdf["_block"].to_numpy(), "_enter": out})

        told = entered.toDF("_k", "_g0", "_enter")
        both = lists.withColumn("_g", F.floor(F.col("_block") / fan).cast("bigint"))
        both = both.join(told, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_g") == F.col("_g0"))).drop("_k", "_g0")
        entered = stored_table(both.groupBy("_key", "_g").applyInPandas(down, f"_key {kind}, _block bigint, _enter bigint"))

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        totals = pdf["_sum"].to_numpy(np.int64)
        i, hit = int(np.searchsorted(totals, pdf["_enter"].iloc[0], side="left")), []
        while i < len(totals):
            hit.append(i)
            i = int(np.searchsorted(totals, totals[i] + goal, side="left"))
        return pd.DataFrame({"_key": same(pdf, len(hit)), "_pos": pdf["_pos"].to_numpy()[hit]})

    told = entered.toDF("_k", "_b", "_enter")
    met = blocks.join(told, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))).drop("_k", "_b")
    return met.groupBy("_key", "_block").applyInPandas(close, f"_key {kind}, _pos bigint")
