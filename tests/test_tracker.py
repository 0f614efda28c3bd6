"""Multi-object tracker: identity, gaps, pieces and the live twin."""

import random

import pytest
from pyspark.sql import functions as F

from gridlark.operators.tracker import TrackerOptions, track_multi

DET = "stream_id bigint, frame_index bigint, det_no bigint, x1 double, y1 double, x2 double, y2 double, conf double, name string"


def scene(frames, skip=(), conf=0.9, step=2.0):
    return [(1, f, 1, 10 + step * f, 20.0, 30 + step * f, 40.0, conf, "c1") for f in frames if f not in skip]


def frames_of(spark, n, streams=(1,)):
    return spark.createDataFrame([(s, f) for s in streams for f in range(n)], "stream_id bigint, frame_index bigint")


def test_id_is_stable(spark):
    out = track_multi(frames_of(spark, 12), spark.createDataFrame(scene(range(12)), DET), ["stream_id"]).collect()
    assert {r.track_id for r in out} == {1} and len(out) == 12
    assert [r.confirmed for r in sorted(out, key=lambda r: r.frame_index)][:2] == [False, True]


def test_id_survives_a_gap_without_overlap(spark):
    at = lambda f: (1, f, 1, 50.0 + 15 * f, 50.0, 70.0 + 15 * f, 70.0, 0.9, [0.6, 0.8])
    det = spark.createDataFrame([at(f) for f in (0, 1, 2, 5)], DET.replace("name string", "vector array<double>"))
    out = track_multi(frames_of(spark, 6), det, ["stream_id"], options=TrackerOptions(dt=1.0, max_age=10)).collect()
    assert {r.track_id for r in out} == {1}
    ages = {r.frame_index: r.time_since_update for r in out}
    assert (ages[4], ages[5]) == (2, 0)


def test_other_looks_keep_tracks_apart(spark):
    rows = [(1, f, 1, 50.0, 50.0, 70.0, 70.0, 0.9, [1.0, 0.0] if f < 3 else [0.0, 1.0]) for f in range(6)]
    det = spark.createDataFrame(rows, DET.replace("name string", "vector array<double>"))
    out = track_multi(frames_of(spark, 6), det, ["stream_id"]).collect()
    assert {r.track_id for r in out} == {1, 2}


def test_weak_boxes_rescue_but_do_not_start(spark):
    det = scene(range(6)) + [(1, f, 1, 10 + 2.0 * f, 20.0, 30 + 2.0 * f, 40.0, 0.2, "c1") for f in range(6, 9)]
    det += [(1, 4, 2, 500.0, 500.0, 520.0, 520.0, 0.3, "c2")]
    out = track_multi(frames_of(spark, 9), spark.createDataFrame(det, DET), ["stream_id"]).collect()
    assert {r.track_id for r in out} == {1}
    assert max(r.hits for r in out) == 9


def test_points_steer_a_coasting_track(spark):
    det = scene(range(4), step=0.0)
    pts = spark.createDataFrame([(1, f, 1, 60.0, 30.0) for f in range(4, 8)], "stream_id bigint, frame_index bigint, point_no bigint, x double, y double")
    plain = track_multi(frames_of(spark, 8), spark.createDataFrame(det, DET), ["stream_id"])
    steered = track_multi(frames_of(spark, 8), spark.createDataFrame(det, DET), ["stream_id"], pts)
    last = lambda df: df.where("frame_index = 7").first()
    assert last(steered).x > last(plain).x + 10 and last(steered).time_since_update == 4


def random_scene(seed, frames=120):
    rng = random.Random(seed)
    rows = []
    for s in (1, 2):
        for f in range(frames):
            if f % 45 > 20:
                continue
            for d in range(rng.randrange(0, 4)):
                x, y = rng.uniform(0, 200), rng.uniform(0, 200)
                rows.append((s, f, d, x, y, x + 20, y + 20, rng.random(), rng.choice(["p", "q", None])))
    return rows


def key(r):
    return (r.stream_id, r.frame_index, r.track_id, r.name, r.hits, r.age, r.time_since_update, round(r.x, 9), round(r.y, 9))


def test_pieces_equal_one_pass(spark):
    """Cutting at quiet stretches gives what one unbroken walk gives."""
    from gridlark.operators.tracker import Stream, frame_arrays

    rows = random_scene(4)
    o = TrackerOptions()
    want = []
    for s in (1, 2):
        stream = Stream()
        for f in range(120):
            now = sorted((r for r in rows if r[0] == s and r[1] == f), key=lambda r: r[2])
            stream.advance(*frame_arrays([(0, *r[3:8], None, r[8], None) for r in now]), o)
            want.extend((s, f, t[0], t[8], t[9], t[10], t[11], round(t[1], 9), round(t[2], 9)) for t in stream.states(o))
    df = spark.createDataFrame(rows, DET).repartition(3)
    got = track_multi(frames_of(spark, 120, (1, 2)), df, ["stream_id"], options=o)
    assert sorted(map(str, map(key, got.collect()))) == sorted(map(str, want))
    sliced = track_multi(frames_of(spark, 120, (1, 2)), df, ["stream_id"], options=o, hot_rows=40)
    assert sorted(map(str, map(key, sliced.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("cell", [30.0, 240.0])
def test_busy_scene_cut_in_space_equals_one_pass(spark, cell):
    """Objects that keep apart, that meet in the end and that points pull over; a third of all rows in one stream."""
    from gridlark.operators.tracker import Stream, frame_arrays

    rng = random.Random(int(cell))
    o = TrackerOptions(dt=1.0, max_age=4, aux_radius=60.0)
    det, pts = [], []
    for s, n in ((1, 5), (2, 2)):
        for d in range(n):
            for f in range(40):
                far = 500 * d - (12 * f if d == 3 else 0)  # the fourth runs into the third
                if rng.random() < 0.7 and not 20 < f < 20 + 3 * d:
                    x, y = far + rng.uniform(-3, 3), 40 * d + rng.uniform(-3, 3)
                    det.append((s, f, d, x, y, x + 20, y + 20, rng.choice([0.9, 0.6, 0.3]), rng.choice(["p", None])))
                if rng.random() < 0.2:
                    pts.append((s, f, d, far + rng.uniform(-70, 70), 40.0 * d))
    want = []
    for s in (1, 2):
        stream = Stream()
        for f in range(40):
            now = sorted((r for r in det if r[0] == s and r[1] == f), key=lambda r: r[2])
            spots = sorted((r for r in pts if r[0] == s and r[1] == f), key=lambda r: r[2])
            rows = [(0, *r[3:8], None, r[8], None) for r in now] + [(1, r[3], r[4]) for r in spots]
            stream.advance(*frame_arrays(rows), o)
            want.extend((s, f, t[0], t[8], t[9], t[10], t[11], round(t[1], 9), round(t[2], 9)) for t in stream.states(o))
    points = spark.createDataFrame(pts, "stream_id bigint, frame_index bigint, point_no bigint, x double, y double")
    got = track_multi(frames_of(spark, 40, (1, 2)), spark.createDataFrame(det, DET).repartition(3), ["stream_id"], points, o, busy_rows=50, cell=cell)
    assert sorted(map(str, map(key, got.collect()))) == sorted(map(str, want))


def test_live_equals_batch(spark, tmp_path):
    from gridlark.streaming import live

    live.use_state_store(spark)
    rows = [r for r in random_scene(7, 60)]
    marks = [(s, f, -1, 0, None, None, None, None, None, None) for s in (1, 2) for f in range(60)]
    data = marks + [(r[0], r[1], 0, r[2], *r[3:]) for r in rows]
    schema = "stream_id bigint, frame bigint, kind int, no bigint, x1 double, y1 double, x2 double, y2 double, conf double, name string"
    table = spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_seconds(F.col("frame") + 1_700_000_000))
    folder = str(tmp_path / "rows")
    table.where("frame < 30").write.parquet(folder)
    table.where("frame >= 30").write.mode("append").parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    got = live.drain(live.live_tracks(stream, "40 seconds")).collect()
    batch = track_multi(frames_of(spark, 60, (1, 2)), spark.createDataFrame(rows, DET), ["stream_id"]).collect()
    done = max(r.frame_index for r in got)
    assert done >= 15
    assert sorted(map(str, map(key, got))) == sorted(str(key(r)) for r in batch if r.frame_index <= done)


def test_frame_log(spark, tmp_path):
    import json

    from gridlark.plans.tracking import track_log
    from gridlark.sources.sinks import write_frame_log

    frames = frames_of(spark, 6).withColumn("gate", F.struct((F.col("frame_index") > 0).alias("triggered")))
    log = track_log(frames, spark.createDataFrame(scene(range(5)), DET))
    write_frame_log(log, str(tmp_path / "log"))
    rows = sorted((json.loads(s) for f in (tmp_path / "log").glob("*.json") for s in f.read_text().splitlines()), key=lambda r: r["frame_index"])
    assert len(rows) == 6 and rows[0]["tracks"] == [] and rows[1]["tracks"][0]["track_id"] == 1
    assert rows[5]["detections"] == [] and len(rows[5]["tracks"]) == 1
    assert rows[3]["timestamp"] == pytest.approx(0.1) and rows[3]["gate"] == {"triggered": True}


def test_frames_torn_between_batches_come_out_whole():
    import pyarrow as pa

    from gridlark.operators.runs import whole_keys
    from gridlark.operators.tracker import _frames

    n = 60
    t = pa.table({
        "s": [1] * 30 + [2] * 30, "frame_index": [k // 12 for k in range(n)], "kind": pa.array([(-1, 0, 0, 1)[k % 12 // 3] for k in range(n)], pa.int32()),
        "no": list(range(n)), **{c: [None if k % 12 < 3 else float(k) for k in range(n)] for c in ("x1", "y1", "x2", "y2", "conf")},
        "class_name": pa.nulls(n, pa.string()), "name": [f"c{k}" for k in range(n)], "vector": pa.nulls(n, pa.list_(pa.float64())),
    })
    lead = ["s", "frame_index"]
    want = None
    for size in (1, 5, 7, 12, 60):
        got = [
            (at, boxes.tolist(), conf.tolist(), looks, points.tolist(), no)
            for at, boxes, conf, looks, points, no in _frames(whole_keys(iter(t.to_batches(max_chunksize=size)), lead), lead)
        ]
        want = want or got
        assert got == want
    assert [g[0] for g in want] == [(1, 0), (1, 1), (1, 2), (2, 2), (2, 3), (2, 4)]
    assert [len(g[1]) + len(g[4]) for g in want] == [9, 9, 3, 6, 9, 9]
    assert want[0][5] == [3, 4, 5, 6, 7, 8] and want[0][3][0] == [None, "c3", None]


@pytest.mark.parametrize("rows", [1, 7, 60, 10_000])
def test_groups_walked_together_equal_walks_of_their_own(rows):
    """Groups that are cut between batches go on where they were, texts, vectors and numbers included."""
    import numpy as np
    import pyarrow as pa

    from gridlark.operators import tracker
    from gridlark.operators.runs import whole_keys

    rng = random.Random(11)
    o = TrackerOptions(max_age=3)
    data, want = [], []
    for s in (1, 2, 3, 4):
        data.append((s, 0, -2, 100 * s, *[None] * 8))
        stream = tracker.Stream()
        for f in range(rng.choice([5, 30])):
            now = [(s, f, -1, 0, *[None] * 8)]
            for d in range(rng.randrange(0, 5)):
                x, y = rng.uniform(0, 60), rng.uniform(0, 60)
                vector = rng.choice([None, [1.0, 0.0], [0.6, 0.8]])
                now.append((s, f, 0, d, x, y, x + 20, y + 20, rng.random(), rng.choice("ab"), rng.choice(["p", "q", "", None]), vector))
            now += [(s, f, 1, p, rng.uniform(0, 60), rng.uniform(0, 60), *[None] * 6) for p in range(rng.randrange(0, 4))]
            data += now
            stream.advance(*tracker.frame_arrays([r[2:3] + r[4:] for r in now]), o)
            want += [(s, f, t[0] + 100 * s, *t[1:]) for t in stream.states(o)]
    types = dict(zip(("s", "frame_index", "kind", "no"), [pa.int64(), pa.int64(), pa.int32(), pa.int64()]))
    types |= {c: pa.float64() for c in ("x1", "y1", "x2", "y2", "conf")} | {"class_name": pa.string(), "name": pa.string(), "vector": pa.list_(pa.float64())}
    table = pa.table({c: pa.array(v, ty) for (c, ty), v in zip(types.items(), zip(*data))})
    streams, got = tracker.Streams(watch=False), []
    for batch in tracker._gathered(whole_keys(iter(table.to_batches(max_chunksize=9)), ["s", "frame_index"]), rows):
        f = tracker.Frames(batch, ["s"], ["s", "frame_index"])
        for at, m, whole in ((a, m.copy(), w.copy()) for a, m, w, _ in streams.walk(f, ["s"], o)):
            m[:, tracker.ID] += f.before[whole[:, tracker.OF]]
            texts = tracker._state_columns(m, whole, list(streams.known), o)
            key = batch.column("s").to_numpy()[f.starts[at]]
            columns = [np.asarray(texts[c]).tolist() if c not in ("class_name", "name") else texts[c].to_pylist() for c in tracker.OUT_COLUMNS]
            got += list(zip(key.tolist(), f.index[at].tolist(), *columns))
    assert len(want) > 100 and sorted(map(str, got)) == sorted(map(str, want))


def test_states_of_quiet_pieces_are_neither_stored_nor_shuffled(spark, monkeypatch):
    from gridlark.operators import tracker

    stored, keep = [], tracker.stored_table
    monkeypatch.setattr(tracker, "stored_table", lambda df: stored.append(df.columns) or keep(df))
    det = spark.createDataFrame(random_scene(4), DET)
    out = track_multi(frames_of(spark, 120, (1, 2)), det, ["stream_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert stored and not any("vx" in columns for columns in stored)
    # nothing is exchanged after the walk
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
