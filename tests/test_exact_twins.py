"""Results that must equal SQL's to the last bit: rounding, sums in order, ties."""

from pyspark.sql import functions as F

import checks
from gridlark.operators import assign, fusion
from tests.compare import connect, difference

BOXES = "frame_id bigint, source_idx int, class_id int, x1 double, y1 double, x2 double, y2 double, conf double"
WEIGHTS = [1.0, 1.2, 1.1]


def test_rounded_equals_sql(spark):
    values = [k / 1280 + 0.0625 for k in range(400)] + [-k / 640 for k in range(200)] + [0.0628125, 0.5, 1e300]
    con = connect("/root/testdata/sf0.001")
    sql = f"SELECT v, round(v, 6) AS r FROM (SELECT unnest({values}::DOUBLE[]) AS v) q"
    assert difference(spark.createDataFrame([(v,) for v in values], "v double").select("v", checks.rounded("v", 6).alias("r")), con, sql) is None


def walk(rows):
    """Plain fold of one frame and class: the SQL's arithmetic, box after box."""
    state = []
    for s, x1, y1, x2, y2 in sorted(rows, key=lambda r: (-r[0], *r[1:])):
        ious = []
        for c in state:
            v = max(0.0, min(c[4] / c[1], x2) - max(c[2] / c[1], x1)) * max(0.0, min(c[5] / c[1], y2) - max(c[3] / c[1], y1))
            ious.append(v / ((c[4] - c[2]) * (c[5] - c[3]) / (c[1] * c[1]) + (x2 - x1) * (y2 - y1) - v))
        if ious and max(ious) > 0.55:
            c = state[ious.index(max(ious))]
            c[0] += 1
            for k, v in enumerate((s, s * x1, s * y1, s * x2, s * y2)):
                c[k + 1] += v
        else:
            state.append([1, s, s * x1, s * y1, s * x2, s * y2])
    return sorted((c[0], c[1] / c[0] * min(3, c[0]) / 3.3, c[2] / c[1], c[3] / c[1], c[4] / c[1], c[5] / c[1]) for c in state)


def test_fusion_equals_plain_fold_to_the_last_bit(spark):
    # few places and many copies, so that overlaps tie and lie on the threshold
    data, frames = [], {}
    for f in range(300):
        for k in range(2 + f % 7):
            h = (f * 7919 + k * 104729) % 9973
            x, y, q = h % 12 * 7 % 40, h % 6 * 5, 1 + h % 50
            box = (x / 100, y / 75, (x + 10 + q) / 100, (y + 10 + q / 2) / 75)
            source, conf = h % 3, 0.2 + (3 + h % 5) / 100 * 7
            for _ in range(1 + h % 4):
                data.append((f, source, 0, *box, conf))
                frames.setdefault(f, []).append((conf * WEIGHTS[source], *box))
    got: dict = {}
    for r in fusion.fuse_boxes(spark.createDataFrame(data, BOXES), ["frame_id"], WEIGHTS).collect():
        got.setdefault(r.frame_id, []).append((r.n_members, r.confidence, r.x1, r.y1, r.x2, r.y2))
    assert {f: sorted(v) for f, v in got.items()} == {f: walk(v) for f, v in frames.items()}


def test_copies_in_several_runs(spark):
    df = spark.range(10_000).select(
        F.lit(1).cast("bigint").alias("frame_id"), F.lit(1).alias("source_idx"), F.lit(0).alias("class_id"),
        *[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (0.1, 0.1, 0.4, 0.3))], F.lit(0.7).alias("conf"),
    )
    (row,) = fusion.fuse_boxes(df, ["frame_id"], WEIGHTS).collect()
    assert [(row.n_members, row.confidence, row.x1, row.y1, row.x2, row.y2)] == walk([(0.7 * 1.2, 0.1, 0.1, 0.4, 0.3)] * 10_000)


def test_equal_totals_spare_the_highest_detection():
    # both ways cost 1.5; {1, 2} is the lower set
    assert assign.best_matching({(1, 3): 0.5, (1, 1): 0.5, (2, 2): 1.0}) == [(1, 1), (2, 2)]
    assert assign.best_matching({(1, 1): 0.25, (1, 2): 0.5, (2, 1): 0.5, (2, 3): 0.75}) == [(1, 2), (2, 1)]
    # a swap through another track: 1-2, 2-1 costs what 1-1, 2-3 does
    assert assign.best_matching({(1, 1): 0.5, (1, 2): 0.75, (2, 1): 0.5, (2, 3): 0.75}) == [(1, 2), (2, 1)]


def test_costs_without_names_follow_the_plain_formula(spark):
    t = spark.createDataFrame([(1, 1, 10.0, 10.0, 13.0, 9.0, 4.7, 2)], "f int, t bigint, x double, y double, w double, h double, p00 double, tsu int")
    d = spark.createDataFrame([(1, k, 5.0 + k / 30, 6.0, 17.0, 15.0 + k / 7) for k in range(40)], "f int, d bigint, x1 double, y1 double, x2 double, y2 double")
    got = {r.d: r.cost for r in assign.candidate_costs(t, d, ["f"], "t", "d").collect()}
    for k, cost in got.items():
        x1, y1, x2, y2 = 5.0 + k / 30, 6.0, 17.0, 15.0 + k / 7
        inter = (min(16.5, x2) - max(3.5, x1)) * (min(14.5, y2) - max(5.5, y1))
        iou = inter / (13.0 * 9.0 + (x2 - x1) * (y2 - y1) - inter)
        dx, dy = (x1 + x2) * 0.5 - 10.0, (y1 + y2) * 0.5 - 10.0
        space = 0.5 * min((dx * dx + dy * dy) / (4.7 + 4.0) / (9.21 * min(3.0, 1.0 + 0.35 * 2)), 2.0)
        assert cost == (0.55 * (1 - iou) + 0.3 * space) / 0.85
    assert len(got) == 40
