"""Folds, chunks and clusters: block sizes must not change results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import components, duty, filters, fusion, gate, grids, sampling


def test_filter_blocks_equal_matrix_form(spark):
    rng = random.Random(1)
    n = 140
    data = [("s", i, 0.0 if i == 1 else rng.uniform(0.01, 0.5), None if i % 7 == 3 else 5.0 * i + rng.gauss(0, 2), 2.0 * i, 16.0 if i % 5 == 0 else 4.0) for i in range(1, n + 1)]
    df = spark.createDataFrame(data, "k string, i bigint, dt double, zx double, zy double, r double")
    # the four-row form the scalar recursion stands for
    want = {}
    x = np.array([data[0][3], data[0][4], 0.0, 0.0])
    P = np.diag([4.0, 4.0, 100.0, 100.0])
    want[1] = x.copy()
    for _, i, dt, zx, zy, r in data[1:]:
        A = np.eye(4)
        A[0, 2] = A[1, 3] = dt
        q = 25.0
        Q = np.kron(np.array([[q * dt * dt, q * dt], [q * dt, q]]), np.eye(2))
        x, P = A @ x, A @ P @ A.T + Q
        if zx is not None:
            H = np.eye(2, 4)
            K = P @ H.T @ np.linalg.inv(H @ P @ H.T + r * np.eye(2))
            x = x + K @ (np.array([zx, zy]) - H @ x)
            P = (np.eye(4) - K @ H) @ P
        want[i] = x.copy()
    for block in (16, 512):
        got = filters.track_filter(df, ["k"], "i", F.col("dt"), F.col("r"), block=block).collect()
        assert len(got) == n
        for row in got:
            assert [row.x, row.y, row.vx, row.vy] == pytest.approx(list(want[row.i]), rel=1e-9, abs=1e-9)


def test_filter_smooths(spark):
    rng = random.Random(4)
    data = [(1, i, 0.033, 3.0 * i + rng.gauss(0, 4), 100.0 + rng.gauss(0, 4), 3.0 * i) for i in range(1, 81)]
    df = spark.createDataFrame(data, "k int, i bigint, dt double, zx double, zy double, true double")
    got = filters.track_filter(df, ["k"], "i", F.col("dt"), q=4.0, meas_var=16.0, noise=16.0).join(df, ["k", "i"]).where("i > 20").collect()
    raw = np.mean([(r.zy - 100) ** 2 for r in got])
    assert np.mean([(r.y - 100) ** 2 for r in got]) < raw


def test_background_blocks(spark):
    rng = random.Random(8)
    data = [(c, i, float(rng.randrange(256))) for c in (1, 2) for i in range(1, 201)]
    df = spark.createDataFrame(data, "c int, i bigint, v double")
    got = {(r.c, r.i): r.background for r in gate.ema_background(df, ["c"], "i", "v", keep=0.5).collect()}
    for c in (1, 2):
        bg = None
        for _, i, v in (r for r in data if r[0] == c):
            if bg is None:
                assert got[c, i] is None
                bg = v
            else:
                assert got[c, i] == pytest.approx(bg, rel=1e-12)
                bg = 0.5 * bg + 0.5 * v


def test_static_cells_skip_and_moving_cells_trigger(spark):
    still = [(1, f, x, y, 100.0) for f in range(1, 6) for x in range(8) for y in range(6)]
    moving = [(2, f, x, y, 250.0 if f > 2 and f <= x + 1 <= f + 2 and 1 <= y <= 3 else 20.0) for f in range(1, 6) for x in range(8) for y in range(6)]
    df = spark.createDataFrame(still + moving, "stream_id int, frame_index bigint, cell_x int, cell_y int, value double")
    diffs = gate.ema_background(df, ["stream_id", "cell_x", "cell_y"], "frame_index", "value")
    out = gate.gate(gate.motion(diffs), gate.regions(diffs, scale=0.1, pad=4, width=80, height=60)).collect()
    assert all(r.skipped for r in out if r.stream_id == 1)
    assert {r.frame_index for r in out if r.stream_id == 2 and r.triggered} >= {3, 4}


@pytest.mark.parametrize("block", [4, 256])
def test_duty_levels(spark, monkeypatch, block):
    monkeypatch.setattr(duty, "BLOCK", block)
    rng = random.Random(12)
    data, want = [], {}
    for s in (1, 2):
        since = 10**9
        for f in range(100):
            flags = [rng.random() < p for p in (0.3, 0.6, 0.2, 0.1, 0.3)]
            trig, conf, pend, stale, odd = flags
            stale, odd = stale and conf, odd and trig and rng.random() < 0.3
            data.append((s, f, trig, conf, pend, stale, trig, odd))
            since += 1
            live = conf or pend
            run = odd or (pend and trig) or (live and (since >= 5 or stale)) or (not live and trig)
            since = 0 if run else since
            want[s, f] = run
    df = spark.createDataFrame(
        data, "stream_id int, frame_index bigint, triggered boolean, confirmed boolean, pending boolean, stale boolean, has_rois boolean, unexplained boolean"
    )
    got = {(r.stream_id, r.frame_index): r.run for r in duty.decide(df, ["stream_id"], "frame_index").collect()}
    assert got == want


def test_duty_without_tracker(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 2, False)], "s int, f int, triggered boolean")
    full = df.withColumns({c: F.lit(False) for c in ("confirmed", "pending", "stale", "has_rois", "unexplained")})
    got = duty.decide(full, ["s"], "f", use_tracker=False).orderBy("f").collect()
    assert [(r.run, r.reason, r.duty_frac) for r in got] == [(True, "predict-no-track", 1.0), (False, "quiet-scene", 0.5)]
    off = duty.decide(full, ["s"], "f", enabled=False).orderBy("f").collect()
    assert [r.reason for r in off] == ["legacy-gate", "legacy-idle"]


@pytest.mark.parametrize("block_rows,hot,fan", [(3, 10_000, 2), (4, 40, 3), (1, 10_000, 2), (1, 40, 2)])
def test_chunks_equal_walk(spark, block_rows, hot, fan):
    """Blocks and levels, pointers (chunks larger than a block), hot groups, a null group, fractions."""
    rng = random.Random(block_rows)
    data = [(g, i, rng.choice([1, 5, 30, 200, 7, 0, None])) for g, n in (("a", 250), ("b", 60), (None, 40)) for i in range(n)]

    def walk(share):
        want = {}
        for g in ("a", "b", None):
            chunk, held = 0, 0
            for _, i, size in (r for r in data if r[0] == g):
                if held >= 100:
                    chunk, held = chunk + 1, 0
                held += round((size or 0) * share * 10**6) / 10**6 if share != 1 else size or 0
                held = round(held, 6)
                want[g, i] = chunk
        return want

    for share, kind in ((1, "bigint"), (0.1, "double")):
        df = spark.createDataFrame([(g, i, s if s is None or share == 1 else s * share) for g, i, s in data], f"g string, i int, size {kind}").repartition(4)
        got = sampling.chunk_by_size(df, "g", ["i"], "size", 100, block_rows=block_rows, fan=fan, hot_rows=hot)
        assert {(r.g, r.i): r.chunk for r in got.collect()} == walk(share)


def test_chunks_of_odd_input(spark):
    df = spark.createDataFrame([("a", 1, -1.0)], "g string, i int, size double")
    assert sampling.chunk_by_size(df.limit(0), "g", ["i"], "size", 5).count() == 0
    with pytest.raises(Exception, match="negative"):
        sampling.chunk_by_size(df, "g", ["i"], "size", 5).collect()
    with pytest.raises(ValueError):
        sampling.chunk_by_size(df, "g", ["i"], "size", 0)


def test_fusion_of_three_sources(spark):
    data = [
        ("f", 0, 2, 0.10, 0.10, 0.30, 0.30, 0.9), ("f", 1, 2, 0.11, 0.10, 0.31, 0.30, 0.85), ("f", 2, 2, 0.10, 0.11, 0.30, 0.31, 0.9),
        ("f", 0, 1, 0.60, 0.60, 0.80, 0.80, 0.2),
    ]
    df = spark.createDataFrame(data, "frame_id string, source_idx int, class_id int, x1 double, y1 double, x2 double, y2 double, conf double")
    got = fusion.fuse_boxes(df, ["frame_id"], [1.0, 1.2, 1.1]).collect()
    assert len(got) == 1 and got[0].class_id == 2 and got[0].n_members == 3
    scores = [0.9 * 1.0, 0.85 * 1.2, 0.9 * 1.1]
    assert got[0].confidence == pytest.approx(sum(scores) / 3 * 3 / 3.3)
    assert 0.85 < got[0].confidence < 1.0
    assert fusion.fuse_boxes(df, ["frame_id"], [1.0, 1.2, 1.1], skip_thr=0.95).count() == 0


def test_fusion_in_slices_equals_whole(spark):
    rng = random.Random(21)
    data = []
    for _ in range(150):
        x, y = rng.random() * 0.8, rng.random() * 0.8
        data.append(("f", rng.randrange(3), rng.randrange(2), x, y, x + 0.1, y + 0.1, rng.random()))
    df = spark.createDataFrame(data, "frame_id string, source_idx int, class_id int, x1 double, y1 double, x2 double, y2 double, conf double")
    key = lambda d: sorted((r.class_id, r.n_members, round(r.confidence, 9), round(r.x1, 9), round(r.y2, 9)) for r in d.collect())
    whole = fusion.fuse_boxes(df, ["frame_id"], [1.0, 1.2, 1.1], 0.3)
    assert key(fusion.fuse_boxes(df, ["frame_id"], [1.0, 1.2, 1.1], 0.3, hot_rows=20)) == key(whole)


def test_copies_count_as_members(spark):
    one = [("f", 0, 1, 0.1, 0.1, 0.4, 0.4, 0.8)] * 40 + [("f", 1, 1, 0.12, 0.1, 0.4, 0.4, 0.6)]
    df = spark.createDataFrame(one, "frame_id string, source_idx int, class_id int, x1 double, y1 double, x2 double, y2 double, conf double")
    got = fusion.fuse_boxes(df, ["frame_id"], [1.0, 1.0]).collect()
    assert len(got) == 1 and got[0].n_members == 41
    assert got[0].x1 == pytest.approx((40 * 0.8 * 0.1 + 0.6 * 0.12) / (40 * 0.8 + 0.6))
    with pytest.raises(ValueError):
        fusion.fuse_boxes(df, ["frame_id"], [1.0, 0.0])


def test_components_both_ways(spark):
    rng = random.Random(6)
    data = [(m, i, float(rng.randrange(30)), float(rng.randrange(30))) for m in (1, 2) for i in range(60)]
    df = spark.createDataFrame(data, "m int, p bigint, x double, y double")
    ways = [{(r.m, r.p): r.component for r in components.components(df, ["m"], "p", 2.5, small=s).collect()} for s in (1000, 1)]
    assert ways[0] == ways[1]
    four = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 10.0, 10.0), (1, 4, 10.0, 11.0)], "m int, p bigint, x double, y double")
    assert components.components(four, ["m"], "p", 2.0).select("component").distinct().count() == 2


def test_persistence_pairs():
    got = components._pairs(np.array([3.0, 1.0, 4.0, 0.0, 5.0, 2.0, 6.0]), 8)
    assert got[:3] == [(0.0, 6.0), (1.0, 4.0), (2.0, 5.0)]
    assert all(b == d for b, d in got[3:])


def test_profile_peak(spark):
    cells = [(1, r, d, 5.0 if r == 12 else 0.1) for r in range(24) for d in range(8)]
    df = spark.createDataFrame(cells, "map_id int, r int, d int, mag double")
    top = grids.row_profile(df).orderBy(F.desc("profile")).first()
    assert top.r == 12
    smooth = grids.smooth(df, [1.0]).groupBy("r").agg(F.avg("s0").alias("s")).orderBy(F.desc("s")).first()
    assert smooth.r == 12


def test_quota_equals_loop(spark):
    rng = random.Random(2)
    boxes = [(i, c) for i in range(80) for c in {rng.randrange(4) for _ in range(rng.randrange(1, 4))}]
    caps = [(3, 7), (0, 12), (1, 25), (2, 5)]
    taken, count = set(), {c: 0 for c in range(4)}
    by_image = {}
    for i, c in boxes:
        by_image.setdefault(i, set()).add(c)
    for c, cap in caps:
        for i in sorted(by_image):
            if i not in taken and c in by_image[i] and count[c] < cap:
                taken.add(i)
                for k in by_image[i]:
                    count[k] += 1
    df = spark.createDataFrame(boxes * 2, "image int, cls int")
    assert {r.image for r in sampling.quota_sample(df, "image", "cls", caps).collect()} == taken


def test_split_sizes(spark):
    ten = spark.range(10)
    got = {r.split: r["count"] for r in sampling.shuffle_split(ten, "id", 0.7, 0.2, 0.1).groupBy("split").count().collect()}
    assert got == {"train": 7, "val": 2, "test": 1}
    same = sampling.shuffle_split(ten, "id", 0.7, 0.2, 0.1, hot_rows=3)
    assert sorted(map(str, same.collect())) == sorted(map(str, sampling.shuffle_split(ten, "id", 0.7, 0.2, 0.1).collect()))
    with pytest.raises(ValueError):
        sampling.shuffle_split(ten, "id", 0.7, 0.2, 0.2)


def test_require_rows(spark):
    assert sampling.require_rows(spark.range(30), 20, "rows").first().rows == 30
    with pytest.raises(Exception, match="not enough"):
        sampling.require_rows(spark.range(3), 20, "rows").collect()


def test_val_fallback_keeps_splits_apart(spark):
    df = spark.range(25).withColumn("split", F.lit("train"))
    out = sampling.val_fallback(df, ["id"])
    assert out.count() == 25 and out.where("split = 'val'").count() == 3
    kept = df.withColumn("split", F.when(F.col("id") == 0, "val").otherwise("train"))
    assert sampling.val_fallback(kept, ["id"]).where("split = 'val'").count() == 1
