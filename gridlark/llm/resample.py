"""Importance resampling of raw texts towards a target by hashed n-gram models.

Two generative models count hashed one- and two-word strings, one of the target texts and
one of the raw texts. The log ratio of a text's probability under them is its weight, and
adding Gumbel noise and taking the greatest sums draws without replacement in proportion
to the weights. The ratio is also a score of how much a text looks like the target.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.columns import broadcast_if_small, free_name
from gridlark.llm.registry import query, table
from gridlark.session import cut_lineage

BUCKETS = 16_384
SMOOTH = 1.0
TEMPERATURE = 0.005
_WORDS_AT_ONCE = 100_000


def buckets(text: str | None, n: int = BUCKETS) -> np.ndarray:
    """How often each bucket of hashed words and word pairs occurs in a text."""
    out = np.zeros(n, np.int64)
    words = (text or "").lower().encode().split()
    for at in range(0, len(words), _WORDS_AT_ONCE):
        w = words[at : at + _WORDS_AT_ONCE + 1]
        own = w[:_WORDS_AT_ONCE]
        grams = own + list(map(b" ".join, zip(w, w[1:])))
        h = np.fromiter(map(xxhash.xxh32_intdigest, grams), np.int64, len(grams))
        out += np.bincount(h % n, minlength=n)
    return out


def _counts(docs: DataFrame, n: int) -> np.ndarray:
    """Exact counts per bucket over all texts; each task sums before anything moves."""

    def run(stream):
        sums = np.zeros(n, np.int64)
        for batch in stream:
            for t in batch.column("text").to_pylist():
                sums += buckets(t, n)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "n"])

    out = np.zeros(n, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(raw: DataFrame, target: DataFrame, n: int = BUCKETS, smooth: float = SMOOTH) -> np.ndarray:
    """Per bucket, the log of its share in the target's texts over its share in the raw texts.

    What comes to the driver is one number per bucket and model, whatever the input.
    """
    of = [_counts(d, n) + smooth for d in (raw, target)]
    share = [c / c.sum() for c in of]
    return np.log(share[1]) - np.log(share[0])


def with_scores(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Add `log_weight`, the log ratio of the text, and `n_grams`, how many it sums over."""
    weight, grams = free_name(docs, "log_weight"), free_name(docs, "n_grams")
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(stream):
        for batch in stream:
            counts = (buckets(t, len(shared.value)) for t in batch.column(batch.schema.get_field_index("text")).to_pylist())
            got = [(float(c @ shared.value), int(c.sum())) for c in counts]
            made = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, weight, grams])

    schema = docs.withColumn(weight, F.lit(0.0)).withColumn(grams, F.lit(0).cast("bigint")).schema
    return docs.mapInArrow(run, schema)


def gumbel(*keys: str, seed: int = 0) -> Column:
    """Standard Gumbel noise that is a function of the row's keys."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def take_greatest(rows: DataFrame, value: str, k: int, tie: str, name: str) -> DataFrame:
    """Mark the `k` rows with the greatest values; equal values go by the least `tie`.

    Null values are never marked. The bound is found by counting bins between the least
    and the greatest value, and bins of the bin it lies in, until few rows or a single
    value are left there; no task sorts the table. Rows that share the bound's value and
    tie are alike and are all marked.
    """
    n, lo, hi = rows.where(F.col(value).isNotNull()).agg(F.count("*"), F.min(value), F.max(value)).first()
    if k >= n:
        return rows.withColumn(name, F.col(value).isNotNull())
    if k <= 0:
        return rows.withColumn(name, F.lit(False))
    above, inside = 0, n
    while inside > 10_000 and lo < hi:
        width = (hi - lo) / 1024
        bins = F.least(F.floor((F.col(value) - lo) / width), F.lit(1023)) if width > 0 else F.col(value)
        held = rows.where((F.col(value) >= lo) & (F.col(value) <= hi)).groupBy(bins.alias("bin"))
        held = held.agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        for b in sorted(held, key=lambda r: -r["bin"]):
            if above + b["n"] >= k:
                break
            above += b["n"]
        lo, hi, inside = b["lo"], b["hi"], b["n"]
    edge = rows.where((F.col(value) >= lo) & (F.col(value) <= hi))
    if lo == hi:
        bound, less = lo, above
    else:  # at most 10,000 rows
        values = sorted((r[0] for r in edge.select(value).collect()), reverse=True)
        bound = values[k - above - 1]
        less = above + sum(v > bound for v in values)
    # of the rows at the bound itself, those with the least ties
    alike = rows.where(F.col(value) == bound).groupBy(tie).count()
    counts = alike.orderBy(F.col(tie).asc_nulls_last()).limit(k - less)
    last = counts.agg(F.max(tie), F.count(F.when(F.col(tie).isNull(), 1))).first()
    at = F.col(tie).isNull() | (F.col(tie) <= F.lit(last[0])) if last[1] else F.coalesce(F.col(tie) <= F.lit(last[0]), F.lit(False))
    marked = (F.col(value) > bound) | ((F.col(value) == bound) & at)
    return rows.withColumn(name, F.coalesce(marked, F.lit(False)))


def importance_resample(
    docs: DataFrame, target: DataFrame, share: float = 0.5, n: int = BUCKETS, temperature: float = TEMPERATURE, seed: int = 0
) -> DataFrame:
    """Rows of `docs`, without the text, with `n_grams`, `log_weight`, `score` and `kept`.

    `score` is the log ratio per string, so long and short texts compare; above zero a
    text looks more like the target than the raw texts do. `kept` marks
    ``round(share * rows)`` rows, drawn without replacement with weights
    ``exp(score / temperature)``: a low temperature draws nearly the best, a high one
    nearly evenly. The target model counts the column `text` of `target`, the raw model all
    of `docs`; only the counts leave the tasks that read the texts. Texts without words
    and null texts have no score and are never drawn. Repeated rows draw the same noise
    and stay or go together. An empty target is even over all strings. New names that
    clash get a leading underscore.
    """
    names = {c: free_name(docs, c) for c in ("log_weight", "n_grams", "score", "kept", "draw")}
    scored = with_scores(docs, log_ratios(docs, target, n))
    score = F.when(F.col(names["n_grams"]) > 0, F.col(names["log_weight"]) / F.col(names["n_grams"]))
    scored = scored.withColumn(names["score"], score).withColumn(names["draw"], F.col(names["score"]) / temperature + gumbel("doc_id", seed=seed))
    narrow = cut_lineage(scored.drop("text"))
    k = int(math.floor(share * narrow.count() + 0.5))
    return take_greatest(narrow, names["draw"], k, "doc_id", names["kept"]).drop(names["draw"])


@query("op5_importance_resampling")
def op5_importance_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labels = cut_lineage(labels)
    good = labels.agg(F.avg("quality")).first()[0]
    target = docs.join(broadcast_if_small(labels.where("quality = 1").select("doc_id")), "doc_id", "left_semi")
    out = importance_resample(docs, target, share=1.0 if good is None else good)
    return out.select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("score", 9).alias("score"), "kept")
