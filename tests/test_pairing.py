"""Coincidence pairing, greedy matching and optimal assignment against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import assign, pairing


def two_queues(a, b, tol):
    """Head-to-head walk over two sorted lists of (ts, seq)."""
    pairs, dropped = [], set()
    i = j = 0
    while i < len(a) and j < len(b):
        d = a[i][0] - b[j][0]
        if abs(d) <= tol:
            pairs.append((a[i][1], b[j][1]))
            i, j = i + 1, j + 1
        elif d > tol:
            dropped.add(("b", b[j][1]))
            j += 1
        else:
            dropped.add(("a", a[i][1]))
            i += 1
    return pairs, dropped


@pytest.mark.parametrize("spread,chunk,hot", [(3000, 7, 10_000), (300, 5, 10_000), (60, 4, 50), (3000, 1000, 10_000)])
def test_coincidence_equals_walk(spark, spread, chunk, hot):
    rng = random.Random(spread + chunk)
    rows, want = [], {}
    for key in ("x", "y"):
        sides = {s: sorted((rng.randrange(spread), 1000 * (s == "b") + i) for i in range(60)) for s in "ab"}
        pairs, dropped = two_queues(sides["a"], sides["b"], 10)
        for s in "ab":
            for ts, q in sides[s]:
                rows.append((key, s, ts, q))
                want[key, s, q] = ("dropped" if (s, q) in dropped else "pending", None)
        for p, q in pairs:
            want[key, "a", p], want[key, "b", q] = ("matched", q), ("matched", p)
    df = spark.createDataFrame(rows, "k string, side string, ts bigint, seq bigint").repartition(5)
    got = pairing.coincidence(df, "side", "ts", "seq", 10, ["k"], chunk_rows=chunk, hot_rows=hot, fan=3).collect()
    assert {(r.k, r.side, r.seq): (r.status, r.partner_seq) for r in got} == want


def test_stated_pairs(spark):
    ms = 1_000_000
    one = spark.createDataFrame([("a", 100 * ms, 1), ("b", 101 * ms, 1)], "side string, ts bigint, seq bigint")
    assert {r.status for r in pairing.coincidence(one, "side", "ts", "seq", 2 * ms).collect()} == {"matched"}
    two = spark.createDataFrame([("a", 100 * ms, 1), ("a", 120 * ms, 2), ("b", 120 * ms + ms // 2, 1)], "side string, ts bigint, seq bigint")
    got = {(r.side, r.seq): (r.status, r.partner_seq) for r in pairing.coincidence(two, "side", "ts", "seq", 2 * ms).collect()}
    assert got == {("a", 1): ("dropped", None), ("a", 2): ("matched", 1), ("b", 1): ("matched", 2)}


def test_counts_on_given_events(spark):
    from checks.joins import _TOL
    from checks.views import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    two = t.events.where("event_type IN ('view', 'click')").select(F.col("event_id").alias("seq"))
    out = pairing.coincidence(t.sensor_events.join(two, "seq"), "sensor_id", "timestamp_ns", "seq", _TOL)
    out = out.groupBy("sensor_id", "status").count().collect()
    got = {(r.sensor_id, r.status): r["count"] for r in out}
    assert got["a", "matched"] == got["b", "matched"] == 310
    assert got["a", "dropped"] == 1670 and got["b", "dropped"] == 1696


def test_live_pairs_equal_batch(spark):
    import checks
    from checks.streams import _LIVE_TOL
    from checks.views import Tables

    checks.load_all()
    sf = "/root/testdata/sf0.01"
    live = {(r.a_seq, r.b_seq) for r in checks.QUERIES["stream_pair"](spark, sf).collect()}
    t = Tables(spark, sf)
    users = t.events.select(F.col("event_id").alias("seq"), "user_id")
    batch = pairing.coincidence(t.sensor_events.join(users, "seq"), "sensor_id", "timestamp_ns", "seq", 1000 * _LIVE_TOL, ["user_id"])
    batch = batch.where("sensor_id = 'a' AND status = 'matched'").collect()
    assert live and live <= {(r.seq, r.partner_seq) for r in batch}
    # only pairs within the delay of the end may still wait
    assert len(batch) - len(live) <= 1


def brute(pairs):
    """Most pairs, then least cost, by trying everything."""
    best = (0, 0.0)
    items = list(pairs)
    for k in range(len(items), 0, -1):
        costs = [
            sum(pairs[p] for p in c) for c in itertools.combinations(items, k)
            if len({r for r, _ in c}) == k and len({d for _, d in c}) == k
        ]
        if costs:
            return k, min(costs)
    return best


def test_best_matching_equals_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        pairs = {(i, j): rng.random() for i in range(n) for j in range(m) if rng.random() < 0.6}
        if not pairs:
            continue
        got = assign.best_matching(pairs)
        k, cost = brute(pairs)
        assert len(got) == k and sum(pairs[p] for p in got) == pytest.approx(cost)


def walk_matchings(pairs):
    """The best matching by a plain walk over all sets of columns, row after row; open ties go to the lowest rows."""
    states = {0: (0, 0.0, ())}
    for r in sorted({r for r, _ in pairs}):
        after = dict(states)
        for m, (n, total, path) in states.items():
            for c in (c for i, c in pairs if i == r and not m >> c & 1):
                new = (n - 1, total + pairs[r, c], (*path, (r, c)))
                after[m | 1 << c] = min(after.get(m | 1 << c, new), new)
        states = after
    return list(min((n, round(total, 9), m, path) for m, (n, total, path) in states.items())[3])


def tied_frames():
    rng = random.Random(3)
    for _ in range(300):
        spots = [(i, j) for i in range(6) for j in range(5) if rng.random() < 0.45]
        yield {p: rng.choice([0.1, 0.2, 0.3, 0.7, 0.6, 1 / 3, 2 / 3]) for p in spots or [(0, 0)]}


def test_ties_fall_as_in_a_plain_walk_over_the_frame():
    # 0.1 + 0.7 + 0.2 and 0.1 + 0.2 + 0.7 differ in the last bit, though the groups on their own tie
    for pairs in tied_frames():
        assert assign.frame_matching(pairs) == walk_matchings(pairs)
        few = assign.frame_matching(pairs, most=1)
        assert len(few) == len(walk_matchings(pairs)) and len({c for _, c in few}) == len({r for r, _ in few}) == len(few)


def test_frames_are_matched_as_in_a_plain_walk(spark, monkeypatch):
    frames = dict(enumerate(tied_frames()))
    rows = [(f, r * 10, c * 10, cost, 0.0, 1.0, 0.0, 1.0) for f, pairs in frames.items() for (r, c), cost in pairs.items()]
    df = spark.createDataFrame(rows, "f int, t bigint, d bigint, cost double, _xlo double, _xhi double, _ylo double, _yhi double")
    want = sorted((f, r * 10, c * 10) for f, pairs in frames.items() for r, c in walk_matchings(pairs))
    take = lambda bound: sorted((r.f, r.t, r.d) for r in assign._matched(df.repartition(3), ["f"], "t", "d", bound).collect())
    assert take(30) == want
    monkeypatch.setattr(assign, "WHOLE_PAIRS", 15)
    assert take(30) == want


def test_assign_optimal_equals_brute_force(spark):
    rng = random.Random(9)
    tr, dt = [], []
    for f in range(12):
        for i in range(4):
            tr.append((f, i, rng.uniform(0, 90), rng.uniform(0, 90), 20.0, 20.0, 4.0, rng.randrange(4), rng.choice(["p", "q", None])))
        for j in range(4):
            x, y = rng.uniform(0, 90), rng.uniform(0, 90)
            dt.append((f, j, x - 10, y - 10, x + 10, y + 10, rng.choice(["p", "q", None])))
    t = spark.createDataFrame(tr, "f int, t bigint, x double, y double, w double, h double, p00 double, tsu int, name string")
    d = spark.createDataFrame(dt, "f int, d bigint, x1 double, y1 double, x2 double, y2 double, name string")
    got = assign.assign_optimal(t, d, ["f"], "t", "d").collect()
    for f in range(12):
        pairs = {}
        for _, ti, x, y, w, h, p00, tsu, tn in (r for r in tr if r[0] == f):
            for _, di, x1, y1, x2, y2, dn in (r for r in dt if r[0] == f):
                iw = max(0, min(x + w / 2, x2) - max(x - w / 2, x1))
                ih = max(0, min(y + h / 2, y2) - max(y - h / 2, y1))
                iou = iw * ih / (w * h + 400 - iw * ih)
                maha = ((x - (x1 + x2) / 2) ** 2 + (y - (y1 + y2) / 2) ** 2) / (p00 + 4)
                wide = 9.21 * min(3, 1 + 0.35 * tsu)
                look = None if not tn or not dn else (0.1 if tn == dn else 0.8)
                if maha > wide and iou < 0.05:
                    continue
                space = 0.5 * min(maha / wide, 2)
                pairs[ti, di] = (
                    0.55 * (1 - iou) + 0.3 * space + 0.3 * look if look is not None else (0.55 * (1 - iou) + 0.3 * space) / 0.85
                )
        k, cost = brute(pairs) if pairs else (0, 0.0)
        mine = [r for r in got if r.f == f]
        assert len(mine) == k and sum(r.cost for r in mine) == pytest.approx(cost)


def test_vectors_decide_between_equal_places(spark):
    t = spark.createDataFrame(
        [(1, 1, 50.0, 50.0, 20.0, 20.0, 4.0, 0, [1.0, 0.0]), (1, 2, 52.0, 50.0, 20.0, 20.0, 4.0, 0, [0.0, 1.0])],
        "f int, t bigint, x double, y double, w double, h double, p00 double, tsu int, vector array<double>",
    )
    d = spark.createDataFrame(
        [(1, 1, 41.0, 40.0, 61.0, 60.0, [0.0, 1.0]), (1, 2, 41.0, 40.0, 61.0, 60.0, [1.0, 0.0])],
        "f int, d bigint, x1 double, y1 double, x2 double, y2 double, vector array<double>",
    )
    got = {(r.t, r.d) for r in assign.assign_optimal(t, d, ["f"], "t", "d").collect()}
    assert got == {(1, 2), (2, 1)}


def test_two_stage_births_only_from_strong(spark):
    t = spark.createDataFrame([(1, 1, 50.0, 50.0, 20.0, 20.0, 4.0, 0)], "f int, t bigint, x double, y double, w double, h double, p00 double, tsu int")
    d = spark.createDataFrame(
        [(1, 1, 40.0, 40.0, 60.0, 60.0, 0.3), (1, 2, 400.0, 400.0, 420.0, 420.0, 0.2), (1, 3, 700.0, 700.0, 720.0, 720.0, 0.9)],
        "f int, d bigint, x1 double, y1 double, x2 double, y2 double, conf double",
    )
    matches, births = assign.assign_two_stage(t, d, ["f"], "t", "d")
    assert [(r.t, r.d, r.stage) for r in matches.collect()] == [(1, 1, 2)]
    assert [r.d for r in births.collect()] == [3]


@pytest.mark.parametrize("scale", [2.0**-20, 1.0, 3.7, 2.0**20])
def test_overlap_pairs_at_any_box_size(spark, scale):
    from gridlark.operators import overlap

    rng = np.random.default_rng(2)
    sizes = rng.uniform(0, 50, (60, 4)) * np.array([1, 1, 1, 1]) * rng.choice([0.01, 1, 30], (60, 1))
    rows = [(1, i, *(float(v * scale) for v in (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(sizes)]
    rows += [(1, 60, 0.0, 0.0, 0.0, 5.0 * scale), (1, 61, None, 0.0, 1.0, 1.0), (2, 62, *rows[0][2:])]
    df = spark.createDataFrame(rows, "f int, n int, x1 double, y1 double, x2 double, y2 double")
    got = [(r.n, r.r_n) for r in overlap.self_pairs(df, ["f"], "n").collect()]
    meet = lambda a, b: min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3])
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and None not in a and None not in b and meet(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_small_frames_meet_whole_and_as_on_cells(spark):
    from gridlark.operators import overlap

    rng = np.random.default_rng(3)
    rows = [(i % 9, i, *(float(v) for v in (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(rng.integers(0, 40, (180, 4)))]
    rows += [(0, 900, None, 0.0, 40.0, 40.0), (0, 901, 0.0, None, 40.0, 40.0), (1, 902, 5.0, 5.0, 5.0, 30.0), (None, 903, 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "f int, n int, x1 double, y1 double, x2 double, y2 double")
    pairs = lambda small: overlap.overlap_pairs(df, df, ["f"], where=F.col("n") < F.col("r_n"), small=small)
    whole, cells = (sorted(map(tuple, pairs(s).select("n", "r_n").collect())) for s in (32, 0))
    assert whole == cells and len(whole) > 100 and sorted(pairs(32).columns) == sorted(pairs(0).columns)
    # no row is copied, so boxes are not exploded over cells
    assert "Generate" not in pairs(32)._jdf.queryExecution().optimizedPlan().toString()


def test_boxes_are_not_shuffled_by_class(spark):
    from gridlark.operators import remap

    vocabulary = spark.createDataFrame([(0, 100), (1, 101)], "raw int, target int")
    boxes = spark.range(10).selectExpr("id % 2 AS class_id", "id")
    out = remap.remap_classes(boxes, vocabulary)
    assert sorted(r.class_id for r in out.collect()) == [100] * 5 + [101] * 5
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_live_all_pairs_equal_interval_pairs(spark, tmp_path):
    """Three batches, one key with most rows, ties, null times and keys; state ends with the watermark."""
    import random

    from pyspark.sql import functions as F

    from gridlark.operators.pairing import interval_pairs
    from gridlark.streaming import live

    live.use_state_store(spark)
    rng = random.Random(2)
    rows = []
    for n in range(600):
        at = 1_700_000_000_000_000 + n * 500_000 + rng.randrange(0, 3) * 250_000
        rows.append((rng.choice(["hot", "hot", "hot", "x", None]), rng.choice("ab"), None if n % 60 == 7 else at, n))
    table = spark.createDataFrame(rows, "k string, side string, us long, seq long").withColumn("ts", F.timestamp_micros("us"))
    folder = str(tmp_path / "rows")
    for lo, hi in ((0, 200), (200, 400), (400, 600)):
        table.where(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.mode("append").parquet(folder)

    def side(name):
        read = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return read.where(F.col("side") == name).select("k", "ts", "us", "seq")

    got = live.drain(live.live_all_pairs(side("a"), side("b"), "ts", 1_500_000, "5 seconds", ["k"])).select("k", "seq", "r_seq").collect()
    a, b = (table.where(F.col("side") == n).select("k", "us", "seq") for n in "ab")
    want = interval_pairs(a, b, "us", 1_500_000, ["k"]).select("k", "seq", "r_seq").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 300


def test_regions_are_drawn_as_the_flags_saw_them(spark):
    from gridlark.operators import duty

    keys = ["stream_id", "frame_index"]
    tracks = spark.createDataFrame([(1, 1, 20.0, 20.0, 10.0, 10.0, 3, 0, True), (1, 2, 90.0, 90.0, 4.0, 4.0, 3, 0, True)], "stream_id int, frame_index int, x double, y double, w double, h double, hits int, time_since_update int, confirmed boolean")
    rois = spark.createDataFrame([(1, 1, 0, 15, 15, 25, 25), (1, 2, 0, 1, 1, 9, 9)], "stream_id int, frame_index int, roi_no int, x1 int, y1 int, x2 int, y2 int")
    frames = spark.createDataFrame([(1, 1, True, 100, 100), (1, 2, True, 100, 100)], "stream_id int, frame_index int, triggered boolean, width int, height int")
    loose = duty.loose_regions(rois, tracks, keys)
    drawn = []
    for given in (None, loose):
        flags = duty.frame_flags(frames, rois, tracks, keys, loose=given)
        drawn.append(sorted(map(tuple, duty.run_regions(duty.decide(flags, keys[:1], keys[1]), rois, tracks, keys, loose=given).collect())))
    assert drawn[0] == drawn[1] and [r.frame_index for r in loose.collect()] == [2]


def test_live_pairing_calls_the_store_by_chunk():
    """Rows far apart in time, late rows and leftovers; calls do not grow with the rows."""
    import pandas as pd

    from gridlark.streaming import live

    calls, timers = [], set()

    class Fake:
        def __init__(self):
            self.map, self.value, self.rows = {}, None, []

        def __getattribute__(self, name):
            if name not in ("map", "value", "rows"):
                calls.append(name)
            return object.__getattribute__(self, name)

        def get(self):
            return iter(self.rows) if self.value is None and self is handle.made["queue"] else self.value

        def exists(self):
            return self.value is not None or bool(self.rows)

        def update(self, v):
            self.value = v

        def clear(self):
            self.value, self.rows = None, []

        def put(self, rows):
            self.rows = rows

        def containsKey(self, k):
            return k in self.map

        def getValue(self, k):
            return self.map.get(k)

        def updateValue(self, k, v):
            self.map[k] = v

        def removeKey(self, k):
            del self.map[k]

    class Handle:
        made = {}

        def _make(self, name, *_):
            return self.made.setdefault(name, Fake())

        getMapState = getValueState = getListState = _make

        def registerTimer(self, at):
            timers.add(at)

    class Times:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    handle, times = Handle(), Times()
    processor = live.PairProcessor(5_000_000)
    processor.init(handle)
    rng = random.Random(4)
    rows = [(rng.choice("ab"), n * 600_000_000 + rng.randrange(8) * 1_000_000, n) for n in range(400)]
    rows += [(rng.choice("ab"), at + rng.randrange(8) * 1_000_000, 1000 + n) for n, (_, at, _) in enumerate(rows[:300])]
    rng.shuffle(rows)
    got = []
    for batch, now in ((rows[:350], 100_000_000), (rows[350:], 180_000_000), ([], 300_000_000)):
        late = [r for r in batch if r[1] > times.now * 1000]
        rows = [r for r in rows if r not in batch or r in late]
        if late:
            list(processor.handleInputRows((1,), iter([pd.DataFrame(late, columns=["side", "at", "seq"])]), times))
        times.now = now
        for at in sorted(t for t in timers if t <= now):
            timers.discard(at)
            for pdf in processor.handleExpiredTimer((1,), times, None):
                got += [tuple(r) for r in pdf[["a_seq", "b_seq"]].itertuples(index=False)]
    a, b = (sorted((at, seq) for s, at, seq in rows if s == side) for side in "ab")
    want, _ = two_queues(a, b, 5_000_000)
    assert {(int(x), int(y)) for x, y in got} == {(x, y) for x, y in want} and len(got) == len(want) > 50
    assert len(calls) < 60
