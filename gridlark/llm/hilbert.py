"""Shards cut from a Hilbert curve through several metadata columns.

Each column is quantised into cells of about equal share, the cells are put in the
order of the curve, and runs of that order become shards. Neighbours on the curve are
close in every column, so a filter on any of them rules out most shards by their
smallest and largest values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.llm.columns import free_name
from gridlark.llm.registry import query, table
from gridlark.session import cut_lineage


def hilbert_index(cells: DataFrame, axes: Sequence[str], bits: int, name: str) -> DataFrame:
    """Add the place on the Hilbert curve of integer coordinates below ``2 ** bits``.

    The transform is Skilling's: undo excess rotations from the top bit down, Gray-code
    the axes, then interleave their bits. Every step is its own projection.
    """
    x = [f"_x{i}" for i in range(len(axes))]
    df = cells.withColumns({a: F.col(c).cast("bigint") for a, c in zip(x, axes)})
    for q in range(bits - 1, 0, -1):
        low = (1 << q) - 1
        for i, a in enumerate(x):
            turned = F.col(a).bitwiseAND(1 << q) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(a)).bitwiseAND(low)
            first = F.when(turned, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]).bitwiseXOR(swap))
            other = {a: F.when(turned, F.col(a)).otherwise(F.col(a).bitwiseXOR(swap))} if i else {}
            if not i:  # the first axis swaps with itself, which leaves it
                first = F.when(turned, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]))
            df = df.withColumns({x[0]: first, **other})
    for before, a in zip(x, x[1:]):
        df = df.withColumn(a, F.col(a).bitwiseXOR(F.col(before)))
    flip = F.lit(0).cast("bigint")
    for q in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(1 << q) != 0, F.lit((1 << q) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_flip", flip)
    place = F.lit(0).cast("bigint")
    for q in range(bits - 1, -1, -1):
        for a in x:
            bit = F.shiftright(F.col(a).bitwiseXOR(F.col("_flip")), q).bitwiseAND(1)
            place = F.shiftleft(place, 1).bitwiseOR(bit)
    return df.withColumn(name, place).drop(*x, "_flip")


def _number(df: DataFrame, name: str) -> Column:
    """A number in the order of the column: text by its first seven bytes."""
    if dict(df.dtypes)[name] in ("string", "binary"):
        head = F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.col(name).cast("double")


def hilbert_shards(
    rows: DataFrame, axes: Sequence[str], ties: Sequence[str], shards: int = 8, bits: int = 4, pieces: int = 1024
) -> DataFrame:
    """Add `shard`, the run of the curve a row falls in, and `slot`, its place there.

    Shards differ by one row at most. Null coordinates share the lowest cell. Rows of one
    cell are dealt by a hash of `ties` into pieces of about ``1 / pieces`` of the table,
    each ordered by `ties`, so no cell has to fit one task however many rows it holds.
    Repeated rows get slots of their own. An empty table stays empty. `shard` and `slot`
    get a leading underscore where `rows` has such columns.

    The cell table has at most ``2 ** (bits * len(axes))`` rows and the piece table at
    most `pieces` more, so both are broadcast. `rows` is stored and then
    read three times: hand over a narrow table, not the texts.
    """
    if any(c.startswith("_") for c in rows.columns):
        held = {c: f"r{i}" for i, c in enumerate(rows.columns)}  # working columns start so
        axes, ties = [held[a] for a in axes], [held[t] for t in ties]
        names = [free_name(rows, "shard"), free_name(rows, "slot")]
        return hilbert_shards(rows.toDF(*held.values()), axes, ties, shards, bits, pieces).toDF(*held, *names)
    share = [i / 2**bits for i in range(1, 2**bits)]
    # plain columns: a lambda over an expression loses its way in the self-join below
    numbers = [f"_n{i}" for i in range(len(axes))]
    placed = cut_lineage(rows.withColumns({n: _number(rows, a) for n, a in zip(numbers, axes)}))
    cuts = placed.agg(*[F.percentile_approx(n, share, 10000).alias(f"q{i}") for i, n in enumerate(numbers)]).first()
    coords = [f"_c{i}" for i in range(len(axes))]
    for c, n, q in zip(coords, numbers, cuts):
        ladder = F.array(*[F.lit(v) for v in sorted(set(q or []))]).cast("array<double>")
        cell = F.size(F.filter(ladder, lambda v: v < F.col(n)))
        placed = placed.withColumn(c, F.coalesce(cell, F.lit(0)) if q else F.lit(0))
        placed = placed.withColumn(c, F.when(F.col(n).isNull(), 0).otherwise(F.col(c)))
    cells = placed.groupBy(*coords).count()
    cells = hilbert_index(cells, coords, bits, "_place").withColumn("_all", F.sum("count").over(W.partitionBy()))
    cells = cut_lineage(cells.withColumn("_parts", F.ceil(F.col("count") * pieces / F.col("_all")).cast("bigint")))
    placed = placed.join(F.broadcast(cells.select(*coords, "_place", "_parts", "_all")), coords)
    placed = placed.withColumn("_piece", F.pmod(F.xxhash64(*ties), F.col("_parts")))

    held = placed.groupBy("_place", "_piece").count()
    before = W.orderBy("_place", "_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("_place", "_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_place", "_piece").orderBy(*ties)
    ranked = placed.withColumn("_rank", F.row_number().over(inside).cast("bigint") - 1)
    ranked = ranked.join(F.broadcast(starts), ["_place", "_piece"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    shard = F.expr(f"(_rank * {shards}) div _all")
    first = F.expr(f"((_rank * {shards}) div _all * _all + {shards - 1}) div {shards}")
    return ranked.select(
        *[F.col(c) for c in rows.columns],
        shard.cast("int").alias(free_name(rows, "shard")),
        (F.col("_rank") - first).alias(free_name(rows, "slot")),
    )


def write_shards(placed: DataFrame, path: str, shard: str = "shard", slot: str = "slot", tasks: int = 64) -> None:
    """One folder per shard, files in curve order, each with tight column ranges."""
    placed.repartitionByRange(tasks, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def document_facts(docs: DataFrame) -> DataFrame:
    """What shards are cut by; the text itself is read once and left behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )


@query("op7_hilbert_sharding")
def op7_hilbert_sharding(spark, sf_dir):
    facts = document_facts(table(spark, sf_dir, "documents"))
    placed = hilbert_shards(facts, ["lang", "source", "size"], ["doc_id", "size", "text_crc32"])
    law = [F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return placed.select("doc_id", "size", "text_crc32", *law, "lang", "source")
