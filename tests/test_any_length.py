"""Answers do not depend on how long a group is, or was when a plan was made."""

import random

import pytest

from gridlark.operators import gate
from gridlark.operators.components import components
from gridlark.operators.ordered import largest_group
from gridlark.operators.tracker import track_multi


def test_sizes_are_not_remembered(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).selectExpr("1 AS k", "id").write.parquet(path)
    assert largest_group(spark.read.parquet(path), ["k"]) == 100
    spark.range(900).selectExpr("1 AS k", "id").write.mode("append").parquet(path)
    assert largest_group(spark.read.parquet(path), ["k"]) == 1000


@pytest.mark.parametrize("n, step, block, fan", [(8, 50, 8, 4), (9, 50, 8, 4), (24, 1, 8, 4), (130, 7, 8, 4), (300, 3, 4, 2), (1000, 50, 256, 256)])
def test_background_equals_a_plain_walk(spark, n, step, block, fan):
    rng = random.Random(n)
    values = [rng.uniform(0, 200) for _ in range(n)]
    at, want, s = 5, {}, None
    rows = []
    for v in values:
        rows.append((1, at, v))
        want[at] = s
        s = v if s is None else 0.85 * s + (1 - 0.85) * v
        at += rng.randrange(1, step + 1)
    rows += [(2, 7, 3.0)]
    want_two = {7: None}
    df = spark.createDataFrame(rows, "c int, i bigint, v double").repartition(5)
    got = gate.ema_background(df, ["c"], "i", "v", block=block, fan=fan).collect()
    assert {r.i: r.background for r in got if r.c == 2} == want_two and len(got) == n + 1
    for r in got:
        if r.c == 1:
            assert (r.background is None) == (want[r.i] is None)
            assert r.background is None or abs(r.background - want[r.i]) < 1e-9


def test_tracks_age_by_frames_not_by_indices(spark):
    frames = spark.createDataFrame([(1, 0), (1, 100)], "stream_id bigint, frame_index bigint")
    det = spark.createDataFrame(
        [(1, f, 1, 10.0, 20.0, 30.0, 40.0, 0.9) for f in (0, 100)],
        "stream_id bigint, frame_index bigint, det_no bigint, x1 double, y1 double, x2 double, y2 double, conf double",
    )
    out = sorted((r.frame_index, r.track_id, r.hits) for r in track_multi(frames, det, ["stream_id"]).collect())
    assert out == [(0, 1, 1), (100, 1, 2)]


def test_long_chain_of_points_settles(spark):
    n = 3000
    ids = random.Random(5).sample(range(10 * n), n)
    points = spark.createDataFrame([(1, i, float(x), 0.0) for x, i in enumerate(ids)], "k int, p bigint, x double, y double")
    got = {r.component for r in components(points, ["k"], "p", 1.0).collect()}
    assert got == {min(ids)}


def plain_filter(rows, q, meas_var=4.0):
    """States after each row (dt, noise, zx, zy, zw), walked one by one."""
    out = []
    x = y = vx = vy = p00 = p01 = p11 = w = 0.0
    for i, (dt, noise, zx, zy, zw) in enumerate(rows):
        if i == 0:
            x, y, vx, vy, p00, p01, p11, w = zx, zy, 0.0, 0.0, meas_var, 0.0, 100.0, max(4.0, zw)
        else:
            x, y = x + vx * dt, y + vy * dt
            p00, p01, p11 = p00 + 2 * dt * p01 + dt * dt * p11 + q * dt * dt, p01 + dt * p11 + q * dt, p11 + q
            if zx is not None:
                k0, k1, dx, dy = p00 / (p00 + noise), p01 / (p00 + noise), zx - x, zy - y
                x, y, vx, vy = x + k0 * dx, y + k0 * dy, vx + k1 * dx, vy + k1 * dy
                p11, p00, p01 = p11 - k1 * p01, p00 * (1 - k0), p01 * (1 - k0)
                w = w if zw is None else 0.8 * w + 0.2 * max(4.0, zw)
        out.append((x, y, vx, vy, p00, p01, p11, w))
    return out


@pytest.mark.parametrize("q, n, block, fan", [(0.0, 5000, 512, 512), (25.0, 1300, 64, 4), (1e-6, 900, 16, 2), (0.5, 513, 512, 512), (3.0, 64, 64, 4)])
def test_filter_equals_a_plain_walk(spark, q, n, block, fan):
    from pyspark.sql import functions as F

    from gridlark.operators.filters import track_filter

    rng = random.Random(n)
    rows = []
    for i in range(n):
        gone = i > 0 and (rng.random() < 0.2 or 100 < i < 180)
        z = (None, None) if gone else (0.3 * i + rng.gauss(0, 2), -0.1 * i + rng.gauss(0, 2))
        rows.append((rng.choice([0.0, 0.03, 0.5]), rng.choice([4.0, 16.0]), *z, None if i and rng.random() < 0.3 else rng.uniform(0, 30)))
    df = spark.createDataFrame([(7, 3 * i, *r) for i, r in enumerate(rows)], "k int, o long, dt double, noise double, zx double, zy double, zw double").repartition(7)
    got = sorted(track_filter(df, ["k"], "o", F.col("dt"), F.col("noise"), q=q, zw="zw", block=block, fan=fan).collect(), key=lambda r: r.o)
    want = plain_filter(rows, q)
    assert [r.o for r in got] == [3 * i for i in range(n)]
    for r, w in zip(got, want):
        for a, b in zip((r.x, r.y, r.vx, r.vy, r.p00, r.p01, r.p11, r.w), w):
            assert abs(a - b) <= 1e-7 * (1 + abs(b))


@pytest.mark.parametrize("block, fan", [(256, 256), (8, 4), (3, 2)])
def test_grids_equal_cells_whatever_the_blocks(spark, block, fan):
    from pyspark.sql import functions as F

    rng = random.Random(block)
    rows, want = [], {}
    for stream, n in ((1, 90), (2, 1), (3, 41)):
        state, at = {}, 0
        for _ in range(n):
            at += rng.randrange(1, 4)
            # a stream's grid grows, and some cells have no reading
            grid = [None if rng.random() < 0.2 else rng.uniform(0, 60) for _ in range(12 if at > 60 else 8)]
            rows.append((stream, at, grid))
            want[stream, at] = [state.get(i) for i in range(len(grid))]
            state.update({i: v if state.get(i) is None else 0.85 * state[i] + (1 - 0.85) * v for i, v in enumerate(grid) if v is not None})
    df = spark.createDataFrame(rows, "stream_id int, frame_index bigint, grid array<double>").repartition(5)
    got = gate.grid_background(df, ["stream_id"], "frame_index", block=block, fan=fan).localCheckpoint()
    for r in got.collect():
        assert len(r.background) == len(r.grid) == len(r.diff)
        for a, b in zip(r.background, want.pop((r.stream_id, r.frame_index))):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    assert not want
    # a frame's grid is one row, so there are no more rows than frames
    cells = got.select("stream_id", "frame_index", F.posexplode("diff").alias("i", "diff"))
    cells = cells.selectExpr("stream_id", "frame_index", "i % 4 AS cell_x", "CAST(i / 4 AS INT) AS cell_y", "diff")
    options = dict(scale=0.1, pad=4, width=40, height=40)
    per_cell = sorted(map(tuple, gate.regions(cells, **options).collect()))
    for bound in (12, 1000):  # inside the row, and as rows
        found = gate.grid_regions(got, 4, cells_per_frame=bound, **options)
        assert sorted(map(tuple, found.select("stream_id", "frame_index", F.inline("regions")).collect())) == per_cell
    assert len(per_cell) > 30
    close = lambda df: sorted((r.stream_id, r.frame_index, round(r.motion_frac, 9), round(r.energy, 6)) for r in df.collect())
    assert close(gate.grid_motion(got)) == close(gate.motion(cells))
