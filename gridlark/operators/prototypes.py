"""Class prototypes and nearest-prototype matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.functions.vectors import l2

PACK = 512


def _entries(items: DataFrame, cls: str, vec: str) -> DataFrame:
    return items.select(F.col(cls), F.posexplode(vec).alias("_pos", "_v"))


def _rebuild(cells: DataFrame, cls: str, name: str) -> DataFrame:
    # one row per class and position: the array is as long as the code, not the class
    rows = F.sort_array(F.collect_list(F.struct("_pos", "_s")))
    return cells.groupBy(cls).agg(F.transform(rows, lambda r: r["_s"]).alias(name))


def bundle(items: DataFrame, cls: str, vec: str, name: str = "prototype") -> DataFrame:
    """Sign of the sum of the class's codes, zero counting as +1.

    Sums are kept per (class, position), so partial sums shrink a large class
    before anything is shuffled.
    """
    sums = _entries(items, cls, vec).groupBy(cls, "_pos").agg(F.sum("_v").alias("_t"))
    signed = sums.select(cls, "_pos", F.when(F.col("_t") < 0, F.lit(-1)).otherwise(F.lit(1)).alias("_s"))
    return _rebuild(signed, cls, name)


def bundle_one_by_one(items: DataFrame, cls: str, vec: str, name: str = "prototype") -> DataFrame:
    """Prototype after adding +1/-1 codes one at a time, each time taking the sign of old plus new.

    A disagreement sums to zero and becomes +1, so an entry stays -1 only while every
    code agrees on -1: the running result is the maximum, whatever the order.
    """
    top = _entries(items, cls, vec).groupBy(cls, "_pos").agg(F.max("_v").alias("_s"))
    return _rebuild(top, cls, name)


def scores(items: DataFrame, prototypes: DataFrame, item_keys: Sequence[str], vec: str, cls: str, proto: str) -> DataFrame:
    """Two best (score, class) entries of every item and block of prototypes, as ``_best``.

    Prototypes are packed in blocks of at most `PACK` classes. One block is broadcast:
    its size is the checked class count times the code length. More blocks meet the
    items by an equi join on the block, salted so no block's items land in one task.
    """
    n = prototypes.count()
    blocks = max(1, -(-n // PACK))
    salts = 1 if blocks == 1 else 64
    entry = F.struct(F.col(cls).alias("c"), F.transform(proto, lambda x: x.cast("double")).alias("p"), l2(F.col(proto)).alias("n"))
    placed = prototypes.select(F.pmod(F.xxhash64(cls), F.lit(blocks)).cast("int").alias("_block"), entry.alias("_e"))
    packed = placed.groupBy("_block").agg(F.sort_array(F.collect_list("_e")).alias("_protos"))
    wide = items.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_norm", l2(F.col(vec)))
    if blocks == 1:
        met = wide.join(F.broadcast(packed), "_block", "left")
    else:
        spread = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = wide.withColumn("_salt", F.pmod(F.xxhash64(*item_keys), F.lit(salts)).cast("int")).join(spread, ["_block", "_salt"], "left").drop("_salt")

    def rate(p):
        dot = F.aggregate(F.zip_with(vec, p["p"], lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        # ascending order puts the best score, then the first class name, in front
        return F.struct((-(dot / (F.col("_norm") * p["n"] + F.lit(1e-8)))).alias("k"), p["c"].alias("c"))

    best = F.slice(F.sort_array(F.transform(F.coalesce("_protos", F.array()), rate)), 1, 2)
    top = met.withColumn("_best", best).drop("_protos", "_norm", "_block")
    if blocks == 1:
        return top
    rest = [c for c in items.columns if c not in item_keys]
    return top.groupBy(*item_keys).agg(
        *[F.first(c).alias(c) for c in rest], F.slice(F.sort_array(F.flatten(F.collect_list("_best"))), 1, 2).alias("_best")
    )


def match(
    items: DataFrame, prototypes: DataFrame, item_keys: Sequence[str], vec: str,
    cls: str = "label", proto: str = "prototype", min_cosine: float = 0.12, conf: str | None = None, conf_below: float = 1.0,
) -> DataFrame:
    """Best class of each item, NULL below `min_cosine`, with its score and margin.

    With `conf`, only less confident items are looked up; the others keep their row.
    """
    wanted = items if conf is None else items.where(F.col(conf) < conf_below)
    rated = scores(wanted.select(*item_keys, vec), prototypes, item_keys, vec, cls, proto)
    first, second = F.get("_best", F.lit(0)), F.get("_best", F.lit(1))
    zero = F.lit(0.0)
    best = F.coalesce(-first["k"], zero)
    got = rated.select(
        *item_keys,
        F.when(best >= min_cosine, first["c"]).alias("match"),
        best.alias("score"),
        (best - F.coalesce(-second["k"], zero)).alias("margin"),
    )
    if conf is None:
        return got
    return items.drop(vec).join(got, list(item_keys), "left")


def margins(table: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Best minus second best score per key (second is 0 when there is one)."""
    order = W.partitionBy(*keys).orderBy(F.col(score).desc())
    ranked = table.select(*keys, score, F.row_number().over(order).alias("_n")).where("_n <= 2")
    best = F.max(F.when(F.col("_n") == 1, F.col(score)))
    second = F.coalesce(F.max(F.when(F.col("_n") == 2, F.col(score))), F.lit(0.0))
    return ranked.groupBy(*keys).agg(best.alias("best"), (best - second).alias("margin"))
