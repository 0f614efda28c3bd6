"""A training mix whose source weights change over time.

Each source has a word target and a weight schedule over training time. The integral of
the schedule is the source's cumulative demand; a copy of a document that fills the
words `start` to `end` of its source's supply is due when half of it is demanded. Sorting
all copies by that time, in ranges, is the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.llm.columns import broadcast_if_small, n_words
from gridlark.llm.registry import query, table
from gridlark.operators.ordered import number_rows, running
from gridlark.session import cut_lineage

WEIGHTS = (5, 2, 1)
#: For each weight in turn: knots (time, relative rate), linear in between.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
MOST_REPEATS = 3
PIECES = 1024


def due(schedule: Sequence[tuple[float, float]], share: Column) -> Column:
    """The time at which `share` (0 to 1) of the schedule's whole integral is reached."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    asked, done, out = share * sum(areas), sum(areas), None
    for ((t0, w0), (t1, w1)), area in reversed(list(zip(zip(schedule, schedule[1:]), areas))):
        done -= area
        rest = F.greatest(asked - done, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * (w1 - w0) / (t1 - t0)), F.lit(0.0)))
        here = F.when(rest > 0, F.least(F.lit(t1), F.lit(t0) + 2 * rest / (w0 + root))).otherwise(F.lit(t0))
        out = here if out is None else F.when(asked <= done + area, here).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Word targets of the sources ``(_null, _name, source_size, ...)``.

    Sources in order, null last, take the weights in turn. The targets are
    ``least(most * size, level * weight)`` with the level at which they add up to all
    words, which is where sharing the excess by weight again and again ends.
    """
    ranked = number_rows(sizes, [], ["_null", "_name"], "_rank")
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("_turn", ((F.col("_rank") - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("_weight", F.get(turn, F.col("_turn")).cast("bigint")).withColumn("_cap", most * F.col("source_size"))
    ranked = cut_lineage(ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight")))
    words, shares = (int(v or 0) for v in ranked.agg(F.sum("source_size"), F.sum("_weight")).first())
    order = ["_ratio", "_null", "_name"]
    walked = running(ranked, [], order, {"_caps": ("sum", F.col("_cap"), False), "_used": ("sum", F.col("_weight"), False)})
    # what the sources after this one could get each, if all before it were full
    left = (F.lit(words) - F.coalesce("_caps", F.lit(0))) / (F.lit(shares) - F.coalesce("_used", F.lit(0)))
    walked = cut_lineage(walked.withColumn("_capped", left > F.col("_ratio")))
    full, open_ = (int(v or 0) for v in walked.agg(F.sum(F.when(F.col("_capped"), F.col("_cap"))), F.sum(F.when(~F.col("_capped"), F.col("_weight")))).first())
    level = float(words - full) / float(open_) if open_ else 0.0
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.lit(level) * F.col("_weight"))
    return walked.select(*sizes.columns, "_turn", target.alias("target"))


def curriculum(
    facts: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    most: int = MOST_REPEATS,
    pieces: int = PIECES,
) -> DataFrame:
    """Copies of documents ``(doc_id, source, size)`` with their place in training.

    Returns each row of `facts` with `source_size`, `target` and `copies`, an array of
    `(copy, position)` with position from 0 to 1, empty where the mix leaves a document
    out. Within a source, documents follow a digest of their id; a copy is taken when its
    middle lies within the target, so a source misses its target by half a document at
    most, and no document is taken more than `most` times. Repeated rows are documents of
    their own. Documents without words take no part. Nothing depends on partitioning.

    A source's running total is cut into pieces of the digest's range, at most `pieces`
    plus one per source, so a hot source is spread over many tasks.
    """
    rows = facts.select("*", F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_name"))
    rows = rows.withColumn("_digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = rows.groupBy("_null", "_name").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sizes = cut_lineage(sizes)
    held = sizes.agg(F.sum("_rows")).first()[0] or 1
    parts = F.ceil(F.col("_rows") * pieces / F.lit(held)).cast("bigint")
    plan = source_targets(sizes, weights, most).withColumn("_parts", parts).drop("_rows")
    plan = cut_lineage(plan)
    rows = rows.join(broadcast_if_small(plan), ["_null", "_name"])
    spread = F.conv(F.substring("_digest", 1, 6), 16, 10).cast("bigint")
    rows = rows.withColumn("_piece", F.shiftright(spread * F.col("_parts"), 24))
    rows = rows.repartition("_null", "_name", "_piece")  # else a join by source leaves a hot source in one task
    sums = rows.groupBy("_null", "_name", "_piece").agg(F.sum("size").alias("_sum"))
    before = W.partitionBy("_null", "_name").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_null", "_name", "_piece", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_null", "_name", "_piece").orderBy("_digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, ["_null", "_name", "_piece"])

    def copy(n: int) -> Column:
        middle = F.col("_start") + F.col("_inside") + n * F.col("source_size") + F.col("size") / 2
        share = middle / F.col("target")
        position = due(schedules[0], share)
        for k in range(1, len(schedules)):
            position = F.when(F.col("_turn") % len(schedules) == k, due(schedules[k], share)).otherwise(position)
        taken = (middle <= F.col("target")) & (F.col("size") > 0)
        return F.when(taken, F.struct(F.lit(n).alias("copy"), position.alias("position")))

    copies = F.array_compact(F.array(*[copy(n) for n in range(most)]))
    return rows.select(*[F.col(c) for c in facts.columns], "source_size", "target", copies.alias("copies"))


def training_order(planned: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per copy, in ranges of training time and sorted within each."""
    each = planned.withColumn("_c", F.explode("copies")).drop("copies")
    each = each.select(*[c for c in each.columns if c != "_c"], F.col("_c.copy").alias("copy"), F.col("_c.position").alias("position"))
    keys = ["position", "doc_id", "copy"]
    ranged = each.repartitionByRange(tasks, *keys) if tasks else each.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


MIX_SQL = """
m0 AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {docs}),
m1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m0 GROUP BY source),
m2 AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 3 * source_size AS cap FROM m1),
m3 AS (SELECT *, cap / w AS ratio, coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(w) OVER before, 0) AS used,
  sum(source_size) OVER () AS words, sum(w) OVER () AS ws FROM m2
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m4 AS (SELECT *, CAST(words - caps AS DOUBLE) / CAST(ws - used AS DOUBLE) > ratio AS capped FROM m3),
m5 AS (SELECT *, coalesce(sum(cap) FILTER (capped) OVER (), 0) AS full_words, sum(w) FILTER (NOT capped) OVER () AS open FROM m4),
m6 AS (SELECT source, source_size,
  CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(words - full_words AS DOUBLE) / CAST(open AS DOUBLE) * w END AS target FROM m5),
m7 AS (SELECT m0.*, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY m0.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun
  FROM m0 JOIN m6 ON m0.source IS NOT DISTINCT FROM m6.source)
"""


@query(
    "op6_mixing_weights",
    f"""WITH {MIX_SQL.format(docs="documents")}
SELECT doc_id, size, source_size, target, size * (CAST(begun + size / 2 <= target AS BIGINT)
  + CAST(begun + source_size + size / 2 <= target AS BIGINT) + CAST(begun + 2 * source_size + size / 2 <= target AS BIGINT)) AS taken FROM m7""",
)
def op6_mixing_weights(spark, sf_dir):
    planned = curriculum(cut_lineage(sized(table(spark, sf_dir, "documents"))))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("bigint").alias("taken"))
