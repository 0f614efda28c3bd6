"""Live twins of the batch operators on Structured Streaming.

Rows may be late by the given delay; a row is acted on once the watermark has
passed it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlark.operators.tracker import OUT_COLUMNS, OUT_DDL, WIDTH, Stream, TrackerOptions, frame_arrays
from gridlark.session import ensure_checkpoint_dir

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is and return what it wrote.

    Output and progress go to a new subfolder of the shared checkpoint folder.
    """
    spark = stream.sparkSession
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    out = f"{base}/out"
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stall_alarms(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """A row per run of activity of `key` once it has been silent for `gap`."""
    timed = events.withWatermark(ts, delay)
    runs = timed.groupBy(key, F.session_window(ts, gap)).agg(
        F.unix_micros(F.max(ts)).alias("last_us"), F.count("*").alias("n_rows")
    )
    return runs.select(key, F.unix_micros("session_window.start").alias("start_us"), "last_us", "n_rows")


class PairProcessor(StatefulProcessor):
    """Coincidence pairing of sides 'a' and 'b' of one key.

    Rows wait in chunks, in time order, until the watermark passes them; then they are
    taken in time order against the queue of the other side. An index holds each chunk's
    first time, so a timer reads the chunks that are due and no others, and a new batch
    writes its own chunks only. Calls of the state store go by chunk and not by row, and
    the queue holds what is within the tolerance.
    """

    def __init__(self, tol_us: int, chunk: int = 1024) -> None:
        self.tol, self.chunk = tol_us, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "number bigint", "body string")
        #: next free number, and first time and number of each chunk
        self.index = handle.getValueState("index", "body string")
        self.queue = handle.getListState("queue", "side string, at bigint, seq bigint")

    def _index(self) -> tuple[int, list]:
        body = self.index.get()
        return (0, []) if body is None else tuple(json.loads(body[0]))

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added: list = []
        for pdf in rows:
            added += zip(pdf["at"].astype(int).tolist(), pdf["side"].tolist(), pdf["seq"].astype(int).tolist())
        if added:
            added.sort()
            number, waiting = self._index()
            # a timer for the soonest chunk is set already
            if not waiting or added[0][0] < min(waiting)[0]:
                self._wake(added[0][0])
            for i in range(0, len(added), self.chunk):
                self.chunks.updateValue((number,), (json.dumps(added[i : i + self.chunk]),))
                waiting.append([added[i][0], number])
                number += 1
            self.index.update((json.dumps([number, waiting]),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        number, waiting = self._index()
        due = [w for w in waiting if w[0] <= upto]
        if not due:
            return
        left, ready = [w for w in waiting if w[0] > upto], []
        for _, n in due:
            rows = json.loads(self.chunks.getValue((n,))[0])
            later = [r for r in rows if r[0] > upto]
            ready += [r for r in rows if r[0] <= upto]
            if later:
                left.append([later[0][0], n])
                self.chunks.updateValue((n,), (json.dumps(later),))
            else:
                self.chunks.removeKey((n,))
        if left:
            self._wake(min(left)[0])
            self.index.update((json.dumps([number, left]),))
        else:
            self.index.clear()
        before = list(self.queue.get())
        queue = deque(tuple(r) for r in before)
        out = []
        for at, side, seq in sorted(ready):
            while queue and queue[0][1] < at - self.tol:
                queue.popleft()
            if queue and queue[0][0] != side:
                other = queue.popleft()
                a, b = ((at, seq), other[1:]) if side == "a" else (other[1:], (at, seq))
                out.append((int(a[1]), int(b[1]), int(a[0]), int(b[0])))
            else:
                queue.append((side, at, seq))
        if queue:
            self.queue.put(list(queue))
        elif before:
            self.queue.clear()
        if out:
            yield pd.DataFrame(out, columns=["a_seq", "b_seq", "a_us", "b_us"])

    def close(self) -> None:
        pass


def live_pairs(events: DataFrame, key: str, tol_us: int, delay: str) -> DataFrame:
    """`events` has ``key, ts, side, seq``; one output row per matched pair."""
    timed = events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    return timed.groupBy(key).transformWithStateInPandas(
        PairProcessor(tol_us), "a_seq bigint, b_seq bigint, a_us bigint, b_us bigint", "append", "EventTime"
    )


def live_all_pairs(left: DataFrame, right: DataFrame, ts: str, tol_us: int, delay: str, keys: Sequence[str] = (), prefix: str = "r_") -> DataFrame:
    """All pairs of two streams with ``|left.ts - right.ts| <= tol_us``, as `interval_pairs` gives for tables.

    Rows meet on `keys` and a time bucket as wide as the tolerance, so a hot key is spread
    over its buckets. Both sides have a watermark and the join bounds one side's time by
    the other's, so a row is kept for the tolerance and the delay and then forgotten.
    Null times and keys pair with nothing; columns of `right` but keys get `prefix`.
    """
    width = max(1, tol_us)
    bucket = F.floor(F.unix_micros(ts) / width)
    lhs = left.withWatermark(ts, delay).withColumn("_b", bucket)
    rhs = right.withWatermark(ts, delay).withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    rhs = rhs.select(*[F.col(c).alias(f"_k_{c}" if c in keys else "_rb" if c == "_b" else prefix + c) for c in rhs.columns])
    span = f"INTERVAL '{tol_us // 1_000_000}.{tol_us % 1_000_000:06d}' SECOND"
    same = F.col("_b") == F.col("_rb")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    near = F.expr(f"`{prefix}{ts}` >= `{ts}` - {span} AND `{prefix}{ts}` <= `{ts}` + {span}")
    return lhs.join(rhs, same & near).drop("_b", "_rb", *[f"_k_{k}" for k in keys])


class TrackProcessor(StatefulProcessor):
    """Multi-object tracker of one stream; frames are taken once the watermark passes them."""

    def __init__(self, options: TrackerOptions) -> None:
        self.o = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState(
            "buffer", "at bigint, frame bigint, kind int, no bigint, x1 double, y1 double, x2 double, y2 double, conf double, class_name string, name string, vector array<double>"
        )
        self.tracks = handle.getValueState("tracks", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["at", "frame", "kind", "no", "x1", "y1", "x2", "y2", "conf", "class_name", "name", "vector"]
        added = []
        for pdf in rows:
            for r in pdf[names].itertuples(index=False, name=None):
                floats = [None if v is None or v != v else float(v) for v in r[4:9]]
                texts = [v if isinstance(v, str) else None for v in r[9:11]]
                vector = None if r[11] is None else [float(v) for v in r[11]]
                added.append((*(int(v) for v in r[:4]), *floats, *texts, vector))
        if added:
            self.buffer.appendList(added)
            for at in (min(a[0] for a in added), max(a[0] for a in added)):
                self.handle.registerTimer(at // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(r) for r in self.buffer.get()), key=lambda r: r[:4])
        ready = [r for r in waiting if r[0] <= upto]
        later = [r for r in waiting if r[0] > upto]
        stream = Stream()
        if self.tracks.exists():
            body = json.loads(self.tracks.get()[0])
            looks = [[c, n, None if v is None else np.array(v)] for c, n, v in body["looks"]]
            stream = Stream(np.array(body["rows"], dtype=float).reshape(-1, WIDTH), looks, body["born"])
        out = []
        for frame in sorted({r[1] for r in ready}):
            rows = [(r[2], *r[4:]) for r in ready if r[1] == frame and r[2] >= 0]
            stream.advance(*frame_arrays(rows), self.o)
            out.extend((key[0], frame, *s) for s in stream.states(self.o))
        looks = [[c, n, None if v is None else v.tolist()] for c, n, v in stream.looks]
        self.tracks.update((json.dumps({"rows": stream.rows.tolist(), "looks": looks, "born": stream.born}),))
        self.buffer.put(later) if later else self.buffer.clear()
        if later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        yield pd.DataFrame(out, columns=["stream_id", "frame_index", *OUT_COLUMNS])

    def close(self) -> None:
        pass


def live_tracks(rows: DataFrame, delay: str, options: TrackerOptions | None = None) -> DataFrame:
    """`rows` has ``stream_id, ts, frame, kind, no, x1..y2, conf``; kind -1 marks a frame.

    `class_name`, `name` (gallery class) and `vector` are optional.
    """
    for c, ty in (("class_name", "string"), ("name", "string"), ("vector", "array<double>")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(ty))
    timed = rows.withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    return timed.groupBy("stream_id").transformWithStateInPandas(
        TrackProcessor(options or TrackerOptions()), "stream_id bigint, frame_index bigint, " + OUT_DDL, "append", "EventTime"
    )


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def _utc(events: DataFrame) -> DataFrame:
    """Zone-free times read as UTC, whatever the session zone is."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return events.withColumn("ts", F.timestamp_micros(us))


def run_stalls(spark: SparkSession, folder: str, pattern: str, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    return drain(stall_alarms(_utc(read_stream(spark, folder, pattern)), "user_id", "ts", gap, delay))


def run_pairs(spark: SparkSession, folder: str, pattern: str, tol_us: int, delay: str = "10 minutes") -> DataFrame:
    use_state_store(spark)
    events = _utc(read_stream(spark, folder, pattern))
    sides = events.select(
        "user_id", "ts", F.when(F.col("event_type") == "view", "a").otherwise("b").alias("side"), F.col("event_id").alias("seq")
    )
    return drain(live_pairs(sides, "user_id", tol_us, delay))


def run_all_pairs(spark: SparkSession, folder: str, pattern: str, tol_us: int, delay: str = "10 minutes") -> DataFrame:
    use_state_store(spark)

    def side(kind: str) -> DataFrame:
        events = _utc(read_stream(spark, folder, pattern)).where(F.col("event_type") == kind)
        return events.select("ts", F.col("event_id").alias("seq"))

    return drain(live_all_pairs(side("view"), side("click"), "ts", tol_us, delay))
