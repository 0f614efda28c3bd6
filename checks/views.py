"""Derived views over the given tables, in Spark and as SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.ordered import number_rows

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

DET_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus",
]


def micros(ts):
    """Epoch microseconds of a zone-free timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


class Tables:
    """The given tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def det(self) -> DataFrame:
        """Boxes of several sources per frame."""
        rows = number_rows(self.lineitem, ["l_orderkey"], DET_ORDER, "det_no")
        return rows.select(
            F.col("l_orderkey").alias("frame_id"),
            "det_no",
            (F.col("l_linenumber") % 3).cast("int").alias("source_idx"),
            (F.col("l_partkey") % 3).cast("int").alias("class_id"),
            ((F.col("l_partkey") * 7) % 40).cast("double").alias("x1"),
            ((F.col("l_suppkey") * 5) % 30).cast("double").alias("y1"),
            (10 + F.col("l_quantity")).alias("bw"),
            (10 + F.col("l_quantity") / 2).alias("bh"),
            (F.lit(0.2) + F.col("l_discount") * 7).alias("conf"),
        ).select(
            "frame_id", "det_no", "source_idx", "class_id", "x1", "y1", "bw", "bh",
            (F.col("x1") + F.col("bw")).alias("x2"), (F.col("y1") + F.col("bh")).alias("y2"), "conf",
        )

    @cached_property
    def images(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("image_id"),
            (480 + 40 * (F.col("o_orderkey") % 40)).cast("int").alias("width"),
            (360 + 30 * (F.col("o_orderkey") % 30)).cast("int").alias("height"),
        )

    @cached_property
    def grid_cells(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.part.select(
            F.floor(k / 100).cast("bigint").alias("map_id"),
            F.floor((k % 100) / 10).cast("int").alias("r"),
            (k % 10).cast("int").alias("d"),
            (((k * 7919) % 997).cast("double") / 100).alias("mag"),
        )

    @cached_property
    def points(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.customer.select(
            F.floor(k / 10).cast("bigint").alias("map_id"),
            k.alias("point_id"),
            ((k * 31) % 23).cast("double").alias("x"),
            ((k * 17) % 19).cast("double").alias("y"),
        )

    @cached_property
    def sized_items(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("seq"), F.col("source").alias("grp"), F.col("n_chars").alias("size"))

    @cached_property
    def done_refs(self) -> DataFrame:
        return self.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("ref"))

    @cached_property
    def latencies(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("run"), "event_id", F.col("value").alias("latency_ms"))

    @cached_property
    def sensor_events(self) -> DataFrame:
        return self.events.select(
            F.when(F.col("event_type") == "view", "a").otherwise("b").alias("sensor_id"),
            F.col("event_id").alias("seq"),
            (micros("ts") * 1000).alias("timestamp_ns"),
            "value",
        )

    @cached_property
    def series(self) -> DataFrame:
        rows = number_rows(self.events, ["user_id"], ["ts", "event_id"], "frame_index")
        return rows.select(F.col("user_id").alias("stream_id"), "frame_index", micros("ts").alias("ts_us"), F.col("value").alias("z"))

    @cached_property
    def label_lines(self) -> DataFrame:
        d = self.det
        whole = lambda c: F.floor(c).cast("bigint")
        x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
        centre = F.format_string(
            "%d %.6f %.6f %.6f %.6f", "class_id", (x1 + x2) / 200, (y1 + y2) / 200, F.col("bw") / 100, F.col("bh") / 100
        )
        pixel = F.format_string(
            "%d,%d,%d,%d,1,%d,0,0", x1.cast("bigint"), y1.cast("bigint"), whole("bw"), whole("bh"), "class_id"
        )
        outline = F.format_string(
            "%d %d %d %d %d %d %d %d class-%d 0",
            x1.cast("bigint"), y1.cast("bigint"), whole("x2"), y1.cast("bigint"),
            whole("x2"), whole("y2"), x1.cast("bigint"), whole("y2"), "class_id",
        )
        kind = F.col("det_no") % 3
        return d.select("frame_id", "det_no", F.when(kind == 0, centre).when(kind == 1, pixel).otherwise(outline).alias("line"))

    @cached_property
    def rois(self) -> DataFrame:
        """One or two regions per frame, drawn from the frame's order."""
        k = F.col("o_orderkey")
        return self.orders.select(
            k.alias("frame_id"),
            F.explode(F.sequence(F.lit(0), (k % 2).cast("int"))).alias("roi_no"),
        ).select(
            "frame_id", "roi_no",
            ((F.col("frame_id") * 3 + F.col("roi_no") * 17) % 45).cast("int").alias("x1"),
            ((F.col("frame_id") * 5 + F.col("roi_no") * 11) % 35).cast("int").alias("y1"),
            ((F.col("frame_id") * 3 + F.col("roi_no") * 17) % 45 + 8 + F.col("frame_id") % 20).cast("int").alias("x2"),
            ((F.col("frame_id") * 5 + F.col("roi_no") * 11) % 35 + 6 + F.col("frame_id") % 15).cast("int").alias("y2"),
        )

    @cached_property
    def tracks(self) -> DataFrame:
        """Track states per (stream, frame), one per detection."""
        conf = F.col("conf")
        return self.det.select(
            (F.col("frame_id") % 50).alias("stream_id"),
            F.col("frame_id").alias("frame_index"),
            F.col("det_no").alias("track_id"),
            ((F.col("x1") + F.col("x2")) * 0.5).alias("x"),
            ((F.col("y1") + F.col("y2")) * 0.5).alias("y"),
            F.col("bw").alias("w"), F.col("bh").alias("h"),
            F.when(conf > 0.6, F.concat(F.lit("class-"), F.col("class_id"))).alias("gallery_class"),
            (conf / 2).alias("gallery_score"),
            F.floor(F.col("bw") % 5).cast("int").alias("hits"),
            F.floor(F.col("bh") % 17).cast("int").alias("time_since_update"),
            (F.floor(F.col("bw") % 5) >= 2).alias("confirmed"),
        )

    @cached_property
    def box_grids(self) -> DataFrame:
        """A small brightness grid per (stream, frame), from the event series: the cells of `box_cells` in order."""
        value = lambda c: ((F.floor(F.col("z") * 100).cast("bigint") * (c + 3) * 7) % 64).cast("double")
        return self.series.select("stream_id", "frame_index", F.transform(F.sequence(F.lit(0), F.lit(15)), value).alias("grid"))


_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "det": ("""
SELECT frame_id, det_no, source_idx, class_id, x1, y1, bw, bh, x1 + bw AS x2, y1 + bh AS y2, conf FROM (
SELECT l_orderkey AS frame_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS BIGINT) AS det_no,
  CAST(l_linenumber % 3 AS INT) AS source_idx, CAST(l_partkey % 3 AS INT) AS class_id,
  CAST((l_partkey * 7) % 40 AS DOUBLE) AS x1, CAST((l_suppkey * 5) % 30 AS DOUBLE) AS y1,
  10 + l_quantity AS bw, 10 + l_quantity / 2 AS bh, CAST(0.2 AS DOUBLE) + l_discount * 7 AS conf
FROM lineitem) t""", ()),
    "images": ("""
SELECT o_orderkey AS image_id, CAST(480 + 40 * (o_orderkey % 40) AS INT) AS width,
  CAST(360 + 30 * (o_orderkey % 30) AS INT) AS height FROM orders""", ()),
    "grid_cells": ("""
SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS map_id, CAST(floor((p_partkey % 100) / 10) AS INT) AS r,
  CAST(p_partkey % 10 AS INT) AS d, CAST((p_partkey * 7919) % 997 AS DOUBLE) / 100 AS mag FROM part""", ()),
    "points": ("""
SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS map_id, c_custkey AS point_id,
  CAST((c_custkey * 31) % 23 AS DOUBLE) AS x, CAST((c_custkey * 17) % 19 AS DOUBLE) AS y FROM customer""", ()),
    "sized_items": ("SELECT doc_id AS seq, source AS grp, n_chars AS size FROM documents", ()),
    "done_refs": ("SELECT o_orderkey AS ref FROM orders WHERE o_orderstatus = 'F'", ()),
    "latencies": ("SELECT event_type AS run, event_id, value AS latency_ms FROM events", ()),
    "sensor_events": ("""
SELECT CASE event_type WHEN 'view' THEN 'a' ELSE 'b' END AS sensor_id, event_id AS seq,
  epoch_us(ts) * 1000 AS timestamp_ns, value FROM events""", ()),
    "series": ("""
SELECT user_id AS stream_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame_index,
  epoch_us(ts) AS ts_us, value AS z FROM events""", ()),
    "label_lines": ("""
SELECT frame_id, det_no, CASE det_no % 3
  WHEN 0 THEN printf('%d %.6f %.6f %.6f %.6f', class_id, (x1 + x2) / 200, (y1 + y2) / 200, bw / 100, bh / 100)
  WHEN 1 THEN printf('%d,%d,%d,%d,1,%d,0,0', CAST(x1 AS BIGINT), CAST(y1 AS BIGINT), CAST(floor(bw) AS BIGINT),
    CAST(floor(bh) AS BIGINT), class_id)
  ELSE printf('%d %d %d %d %d %d %d %d class-%d 0', CAST(x1 AS BIGINT), CAST(y1 AS BIGINT), CAST(floor(x2) AS BIGINT),
    CAST(y1 AS BIGINT), CAST(floor(x2) AS BIGINT), CAST(floor(y2) AS BIGINT), CAST(x1 AS BIGINT),
    CAST(floor(y2) AS BIGINT), class_id) END AS line FROM det""", ("det",)),
    "rois": ("""
SELECT o_orderkey AS frame_id, CAST(n AS INT) AS roi_no,
  CAST((o_orderkey * 3 + n * 17) % 45 AS INT) AS x1, CAST((o_orderkey * 5 + n * 11) % 35 AS INT) AS y1,
  CAST((o_orderkey * 3 + n * 17) % 45 + 8 + o_orderkey % 20 AS INT) AS x2,
  CAST((o_orderkey * 5 + n * 11) % 35 + 6 + o_orderkey % 15 AS INT) AS y2
FROM orders, (VALUES (0), (1)) v(n) WHERE n <= o_orderkey % 2""", ()),
    "tracks": ("""
SELECT frame_id % 50 AS stream_id, frame_id AS frame_index, det_no AS track_id, (x1 + x2) * 0.5 AS x, (y1 + y2) * 0.5 AS y,
  bw AS w, bh AS h, CASE WHEN conf > 0.6 THEN 'class-' || class_id END AS gallery_class, conf / 2 AS gallery_score,
  CAST(floor(bw % 5) AS INT) AS hits, CAST(floor(bh % 17) AS INT) AS time_since_update, floor(bw % 5) >= 2 AS confirmed
FROM det""", ("det",)),
    "box_cells": ("""
SELECT stream_id, frame_index, CAST(cell % 4 AS INT) AS cell_x, CAST(cell // 4 AS INT) AS cell_y,
  CAST((CAST(floor(z * 100) AS BIGINT) * (cell + 3) * 7) % 64 AS DOUBLE) AS value
FROM series, range(16) c(cell)""", ("series",)),
}


def with_views(sql: str) -> str:
    """Prefix `sql` with the derived views it names."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        if name in wanted:
            return
        for dep in _SQL[name][1]:
            visit(dep)
        wanted.append(name)

    for name in _SQL:
        if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", sql, re.I):
            visit(name)
    if not wanted:
        return sql.strip()
    views = ",\n".join(f"{n} AS ({_SQL[n][0].strip()})" for n in wanted)
    body = sql.strip()
    recursive = re.match(r"WITH\s+RECURSIVE\s+", body, re.I)
    plain = re.match(r"WITH\s+", body, re.I)
    if recursive:
        return f"WITH RECURSIVE {views},\n{body[recursive.end():]}"
    if plain:
        return f"WITH {views},\n{body[plain.end():]}"
    return f"WITH {views}\n{body}"
