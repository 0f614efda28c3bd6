"""Consensus of boxes from several sources (weighted boxes fusion)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.operators.assign import axis_islands
from gridlark.operators.ordered import HOT_ROWS, largest_group

_STATE = "array<struct<n:bigint,sw:double,top:double,a:double,b:double,c:double,d:double>>"
_RUN = 4096


def _fused(c: Column):
    return c["a"] / c["sw"], c["b"] / c["sw"], c["c"] / c["sw"], c["d"] / c["sw"]


def _step(iou_thr: float):
    def grow(c, r):
        w = r["s"]
        return F.struct(
            (c["n"] + 1).alias("n"), (c["sw"] + w).alias("sw"), F.greatest(c["top"], r["s"]).alias("top"),
            (c["a"] + w * r["x1"]).alias("a"), (c["b"] + w * r["y1"]).alias("b"),
            (c["c"] + w * r["x2"]).alias("c"), (c["d"] + w * r["y2"]).alias("d"),
        )

    def fresh(r):
        w = r["s"]
        return F.struct(
            F.lit(1).cast("bigint").alias("n"), w.alias("sw"), r["s"].alias("top"), (w * r["x1"]).alias("a"), (w * r["y1"]).alias("b"),
            (w * r["x2"]).alias("c"), (w * r["y2"]).alias("d"),
        )

    def score(c, r):
        """IoU from the sums themselves, in the order of the plain formula, so that ties fall as they do there."""
        mine = (r["x1"], r["y1"], r["x2"], r["y2"])
        inter = B.intersection(_fused(c), mine)
        area = (c["c"] - c["a"]) * (c["d"] - c["b"]) / (c["sw"] * c["sw"])
        return F.transform(
            F.array(inter), lambda v: v / (area + (r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) - v)
        )[0]

    def step(state, r):
        scores = F.transform(state, lambda c: score(c, r))
        # bind the scores once, then pick the first best cluster above the threshold
        bound = F.transform(
            F.array(scores),
            lambda v: F.when(
                F.coalesce(F.array_max(v), F.lit(0.0)) > iou_thr,
                F.transform(
                    state, lambda c, i: F.when(i == F.array_position(v, F.array_max(v)) - 1, grow(c, r)).otherwise(c)
                ),
            ).otherwise(F.concat(state, F.array(fresh(r)))),
        )
        return F.element_at(bound, 1)

    def copies(state, r):
        # equal copies one after the other: sums of doubles depend on the order; runs keep the arrays short
        run = lambda st, k: F.aggregate(
            F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(_RUN), r["n"] - k * _RUN)), st, lambda s, _: step(s, r)
        )
        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.floor((r["n"] - 1) / _RUN).cast("bigint")), state, run)

    return copies


def fuse_boxes(
    boxes: DataFrame,
    frame_keys: Sequence[str],
    weights: Sequence[float],
    iou_thr: float = 0.55,
    skip_thr: float = 0.35,
    conf_type: str = "avg",
    allow_overflow: bool = False,
    cls: str = "class_id",
    source: str = "source_idx",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per fused box of each (frame, class). Boxes are shares of the frame.

    Equal copies are counted before the shuffle and folded one after the other. Boxes that cannot overlap, even
    through averaging, are separated along x and then y, because an average of boxes
    stays inside the span they cover. The ordered fold then runs per such group
    inside the JVM.
    """
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    keys = [*frame_keys, cls]
    unit = [F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0)).alias(c) for c in ("x1", "y1", "x2", "y2")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col(source) + 1)
    scored = boxes.where((F.col("conf") > 0) & (F.col("conf") >= skip_thr)).select(
        *keys, *unit, (F.col("conf") * weight).alias("s")
    )
    kept = scored.where("x2 > x1 AND y2 > y1")
    copies = kept.groupBy(*keys, "x1", "y1", "x2", "y2", "s").agg(F.count("*").alias("n"))
    spans = copies.withColumns(
        {"_xlo": F.col("x1"), "_xhi": F.col("x2"), "_ylo": F.col("y1"), "_yhi": F.col("y2")}
    )
    groups = axis_islands(spans, keys, ["s", "x1", "y1", "x2", "y2"], largest_group(boxes, keys), hot_rows)
    row = F.struct((-F.col("s")).alias("k"), "x1", "y1", "x2", "y2", "s", "n")
    folded = groups.groupBy(*keys, "_ix", "_iy").agg(
        F.aggregate(F.array_sort(F.collect_list(row)), F.array().cast(_STATE), _step(iou_thr)).alias("_c")
    )
    c = F.col("c")
    # the sum of the weights as written: 3.3 for 1.0, 1.2 and 1.1
    total = float(sum(Decimal(repr(float(w))) for w in weights))
    if conf_type == "max":
        score = c["top"] / float(max(weights))
    elif allow_overflow:
        score = c["sw"] / c["n"] * c["n"] / total
    else:
        score = c["sw"] / c["n"] * F.least(F.lit(len(weights)), c["n"]) / total
    out = folded.select(*keys, F.explode("_c").alias("c")).select(
        *keys, score.alias("confidence"), c["n"].alias("n_members"), *[v.alias(n) for v, n in zip(_fused(c), ("x1", "y1", "x2", "y2"))]
    )
    xc, yc, w, h = B.to_cxcywh(B.box())
    out = out.withColumns({"xc": xc, "yc": yc, "bw": w, "bh": h})
    return out.where("bw > 0 AND bh > 0")
