"""Per-row box, clock and geometry expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, rounded
from gridlark.functions import boxes as B
from gridlark.functions import timing as T
from gridlark.operators import overlap, windows

KEY = ["frame_id", "det_no"]


def _const(*values):
    return tuple(F.lit(float(v)) for v in values)


def _named(values, prefix=""):
    return [v.alias(prefix + n) for v, n in zip(values, ("x1", "y1", "x2", "y2"))]


@check("conf_filter", """
SELECT frame_id, det_no, conf, CASE WHEN conf >= 0.5 THEN 'high' ELSE 'low' END AS band FROM det WHERE conf >= 0.3
""")
def _(t):
    return overlap.confidence_bands(t.det, low=0.3, high=0.5).select(*KEY, "conf", "band")


@check("box_area", "SELECT frame_id, det_no, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area FROM det")
def _(t):
    return t.det.select(*KEY, B.area(B.box()).alias("area"))


@check("box_clip", """
SELECT frame_id, roi_no, CAST(least(greatest(x1 - 5, 0), 39) AS INT) AS x1, CAST(least(greatest(y1 - 5, 0), 29) AS INT) AS y1,
  CAST(least(greatest(x2 - 5, 1), 40) AS INT) AS x2, CAST(least(greatest(y2 - 5, 1), 30) AS INT) AS y2 FROM rois
""")
def _(t):
    shifted = B.offset(B.box(), -5, -5)
    return t.rois.select("frame_id", "roi_no", *_named(B.clip(shifted, 40, 30)))


@check("box_center", "SELECT frame_id, det_no, (x1 + x2) * 0.5 AS cx, (y1 + y2) * 0.5 AS cy FROM det")
def _(t):
    cx, cy = B.center(B.box())
    return t.det.select(*KEY, cx.alias("cx"), cy.alias("cy"))


@check("box_iou", """
WITH p AS (SELECT *, greatest(0, least(x2, 45) - greatest(x1, 15)) * greatest(0, least(y2, 40) - greatest(y1, 12)) AS inter FROM det)
SELECT frame_id, det_no, CASE WHEN (x2 - x1) * (y2 - y1) + 840.0::DOUBLE - inter > 0
  THEN inter / ((x2 - x1) * (y2 - y1) + 840.0::DOUBLE - inter) ELSE 0 END AS iou FROM p
""")
def _(t):
    return t.det.select(*KEY, B.iou(B.box(), _const(15, 12, 45, 40)).alias("iou"))


@check("box_cover", """
WITH p AS (SELECT d.frame_id, d.det_no, r.roi_no,
  greatest(0, least(d.x2, r.x2) - greatest(d.x1, r.x1)) * greatest(0, least(d.y2, r.y2) - greatest(d.y1, r.y1)) AS inter,
  (d.x2 - d.x1) * (d.y2 - d.y1) AS box_area, CAST((r.x2 - r.x1) * (r.y2 - r.y1) AS DOUBLE) AS roi_area
  FROM det d JOIN rois r ON d.frame_id = r.frame_id)
SELECT frame_id, det_no, roi_no, inter / box_area AS of_box, inter / roi_area AS of_roi FROM p WHERE inter > 0
""")
def _(t):
    pairs = overlap.overlap_pairs(t.det, t.rois, ["frame_id"], right_prefix="r_")
    a, b = B.box(), B.box("r_")
    return pairs.select(
        *KEY, F.col("r_roi_no").alias("roi_no"), B.cover(a, b).alias("of_box"), B.cover(b, a).alias("of_roi")
    )


@check("box_normalise", """
WITH p AS (SELECT frame_id, det_no, least(greatest(x1 / 50, 0), 1) AS x1, least(greatest(y1 / 35, 0), 1) AS y1,
  least(greatest(x2 / 50, 0), 1) AS x2, least(greatest(y2 / 35, 0), 1) AS y2 FROM det)
SELECT * FROM p WHERE x2 > x1 AND y2 > y1
""")
def _(t):
    boxes = t.det.select(*KEY, *_named(B.normalise(B.box(), F.lit(50), F.lit(35))))
    return boxes.where("x2 > x1 AND y2 > y1")


@check("box_cxcywh", """
SELECT frame_id, det_no, x1 + (x2 - x1) / 2 AS xc, y1 + (y2 - y1) / 2 AS yc, x2 - x1 AS w, y2 - y1 AS h FROM det
""")
def _(t):
    return t.det.select(*KEY, *[v.alias(n) for v, n in zip(B.to_cxcywh(B.box()), ("xc", "yc", "w", "h"))])


@check("box_offset", """
SELECT d.frame_id, d.det_no, r.roi_no, d.x1 + r.x1 AS x1, d.y1 + r.y1 AS y1, d.x2 + r.x1 AS x2, d.y2 + r.y1 AS y2
FROM det d JOIN rois r ON d.frame_id = r.frame_id AND r.roi_no = d.det_no % 2
""")
def _(t):
    crops = t.rois.select("frame_id", "roi_no", F.col("x1").alias("crop_x"), F.col("y1").alias("crop_y"))
    local = t.det.withColumn("roi_no", (F.col("det_no") % 2).cast("int"))
    joined = local.join(crops, ["frame_id", "roi_no"])
    return joined.select(*KEY, "roi_no", *_named(B.offset(B.box(), "crop_x", "crop_y")))


@check("box_letterbox", """
SELECT image_id, 640 / greatest(width, height) AS scale, CAST(trunc(width * (640 / greatest(width, height))) AS INT) AS new_w,
  CAST(trunc(height * (640 / greatest(width, height))) AS INT) AS new_h, greatest(width, height) / 640.0::DOUBLE AS inverse FROM images
""")
def _(t):
    return t.images.select("image_id", *[c.alias(n) for n, c in B.letterbox("width", "height", 640).items()])


@check("roi_pad", """
SELECT frame_id, det_no, CAST(least(greatest(CAST(trunc(x1) AS INT) - 16, 0), 59) AS INT) AS x1,
  CAST(least(greatest(CAST(trunc(y1) AS INT) - 16, 0), 44) AS INT) AS y1,
  CAST(least(greatest(CAST(trunc(x2) AS INT) + 16, 1), 60) AS INT) AS x2,
  CAST(least(greatest(CAST(trunc(y2) AS INT) + 16, 1), 45) AS INT) AS y2 FROM det
""")
def _(t):
    return t.det.select(*KEY, *_named(B.pad_roi(B.box(), 16, 60, 45)))


_TILE_SQL = """
side AS (SELECT *, greatest(32, x2 - x1 + 8, y2 - y1 + 8) AS side FROM b),
s0 AS (SELECT *, (x1 + x2) // 2 - side // 2 AS ax, (y1 + y2) // 2 - side // 2 AS ay FROM side),
s1 AS (SELECT *, CASE WHEN ax < 0 THEN 0 ELSE ax END AS bx, CASE WHEN ay < 0 THEN 0 ELSE ay END AS vy FROM s0),
s2 AS (SELECT *, CASE WHEN bx + side > w THEN w - side ELSE bx END AS cx, CASE WHEN vy + side > h THEN h - side ELSE vy END AS cy FROM s1),
s3 AS (SELECT *, greatest(0, cx) AS tx1, greatest(0, cy) AS ty1, least(w, cx + side) AS tx2, least(h, cy + side) AS ty2 FROM s2),
tiled AS (SELECT *, CAST(least(greatest(tx1, 0), w - 1) AS INT) AS ox1, CAST(least(greatest(ty1, 0), h - 1) AS INT) AS oy1,
  CAST(least(greatest(tx2, 1), w) AS INT) AS ox2, CAST(least(greatest(ty2, 1), h) AS INT) AS oy2 FROM s3)
"""


@check("tile_expand", f"""
WITH b AS (SELECT *, 60 AS w, 45 AS h FROM rois), {_TILE_SQL}
SELECT frame_id, roi_no, ox1 AS x1, oy1 AS y1, ox2 AS x2, oy2 AS y2 FROM tiled
""")
def _(t):
    return t.rois.select("frame_id", "roi_no", *_named(B.expand_tile(B.box(), 60, 45, min_side=32, pad=4)))


@check("crop_plan", f"""
WITH b AS (SELECT frame_id, roi_no, least(greatest(x1, 0), 59) AS x1, least(greatest(y1, 0), 44) AS y1,
  least(greatest(x2, 1), 60) AS x2, least(greatest(y2, 1), 45) AS y2, 60 AS w, 45 AS h FROM rois), {_TILE_SQL},
planned AS (SELECT *, greatest(0, x2 - x1) * greatest(0, y2 - y1) < 0.1 * (w * h) AS tiny FROM tiled)
SELECT frame_id, roi_no, CASE WHEN bool_or(tiny) OVER (PARTITION BY frame_id) THEN 'tile' ELSE 'crop' END AS mode,
  CAST(CASE WHEN tiny THEN ox1 ELSE x1 END AS INT) AS x1, CAST(CASE WHEN tiny THEN oy1 ELSE y1 END AS INT) AS y1,
  CAST(CASE WHEN tiny THEN ox2 ELSE x2 END AS INT) AS x2, CAST(CASE WHEN tiny THEN oy2 ELSE y2 END AS INT) AS y2 FROM planned
""")
def _(t):
    frames = t.rois.withColumns({"width": F.lit(60), "height": F.lit(45)})
    plan = windows.crop_plan(frames, ["frame_id"], tiny_frac=0.1, min_side=32, pad=4)
    return plan.select("frame_id", "roi_no", "mode", "x1", "y1", "x2", "y2")


@check("decode_scores", """
WITH s AS (SELECT frame_id, det_no, x1, y1, bw, bh,
  [((frame_id * 7 + det_no * 13) % 11) / 10.0::DOUBLE, ((frame_id * 3 + det_no * 5) % 11) / 10.0::DOUBLE,
   ((frame_id * 5 + det_no * 2) % 11) / 10.0::DOUBLE] AS scores FROM det)
SELECT frame_id, det_no, CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS class_id, list_max(scores) AS conf,
  (x1 - bw / 2) * 1.5::DOUBLE AS x1, (y1 - bh / 2) * 1.5::DOUBLE AS y1, (x1 + bw / 2) * 1.5::DOUBLE AS x2, (y1 + bh / 2) * 1.5::DOUBLE AS y2
FROM s WHERE list_max(scores) >= 0.5
""")
def _(t):
    f, n = F.col("frame_id"), F.col("det_no")
    scores = F.array(*[((f * a + n * b) % 11) / F.lit(10.0) for a, b in ((7, 13), (3, 5), (5, 2))])
    cls, conf, corners = B.decode_scores(scores, tuple(F.col(c) for c in ("x1", "y1", "bw", "bh")), F.lit(960 / 640))
    return t.det.select(*KEY, cls.alias("class_id"), conf.alias("conf"), *_named(corners)).where("conf >= 0.5")


@check("colour_bucket", """
WITH c AS (SELECT frame_id, det_no, (frame_id * 37 + det_no * 11) % 256 AS r, (frame_id * 53 + det_no * 7) % 256 AS g,
  (frame_id * 29 + det_no * 3) % 256 AS b FROM det)
SELECT frame_id, det_no, CASE WHEN r >= g AND r >= b AND r > 80 THEN 'red' WHEN b >= g AND b >= r AND b > 80 THEN 'blue'
  WHEN g >= r AND g >= b AND g > 80 THEN 'green' ELSE 'object' END AS colour FROM c
""")
def _(t):
    f, n = F.col("frame_id"), F.col("det_no")
    red, green, blue = (f * 37 + n * 11) % 256, (f * 53 + n * 7) % 256, (f * 29 + n * 3) % 256
    return t.det.select(*KEY, B.colour_bucket(red, green, blue).alias("colour"))


@check("roi_to_detection", """
SELECT frame_id, CAST(roi_no AS INT) AS class_id, 'object' AS class_name, 0.6::DOUBLE AS conf,
  CAST(least(greatest(x1, 0), 39) AS DOUBLE) AS x1, CAST(least(greatest(y1, 0), 29) AS DOUBLE) AS y1,
  CAST(least(greatest(x2, 1), 40) AS DOUBLE) AS x2, CAST(least(greatest(y2, 1), 30) AS DOUBLE) AS y2 FROM rois
""")
def _(t):
    frames = t.rois.withColumns({"width": F.lit(40), "height": F.lit(30)})
    return windows.roi_to_detection(frames, "roi_no").select(
        "frame_id", "class_id", "class_name", "conf", "x1", "y1", "x2", "y2"
    )


@check("polar_project", """
WITH p AS (SELECT frame_id, det_no, x1 - 20 AS dx, 60 - y1 AS dy, bw - 30 AS vx, bh - 20 AS vy FROM det),
q AS (SELECT *, sqrt(dx * dx + dy * dy) AS rng FROM p)
SELECT frame_id, det_no, round(rng, 6) AS range, round(atan2(dx, dy), 6) AS bearing,
  round((vx * dx + (-vy) * dy) / (rng + 1e-6), 6) AS radial, round(rng / 200 * 63, 6) AS range_bin,
  round(((vx * dx + (-vy) * dy) / (rng + 1e-6) / 80 + 0.5) * 31, 6) AS speed_bin FROM q
""")
def _(t):
    p = T.polar(F.col("x1"), F.col("y1"), F.col("bw") - 30, F.col("bh") - 20, 20, 60)
    r6 = lambda c: rounded(c, 6)
    return t.det.select(
        *KEY, r6(p["range"]).alias("range"), r6(p["bearing"]).alias("bearing"), r6(p["radial"]).alias("radial"),
        r6(T.range_bin(p["range"], 200, 64)).alias("range_bin"), r6(T.speed_bin(p["radial"], 40, 32)).alias("speed_bin"),
    )


@check("clock_drift", """
SELECT event_id, CAST(trunc(1700000000000000000 + (event_id * 1000003 * (1.0::DOUBLE + value * 1e-6::DOUBLE))) AS BIGINT) AS ts_ns,
  epoch_us(ts) * 1000 / 1e9::DOUBLE AS ts_sec FROM events
""")
def _(t):
    from checks.views import micros

    raw = F.col("event_id") * 1000003
    return t.events.select(
        "event_id",
        T.drift_ns(F.lit(1700000000000000000), raw, F.col("value")).alias("ts_ns"),
        T.ns_to_seconds(micros("ts") * 1000).alias("ts_sec"),
    )


@check("ts_deadline", """
WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'not a time' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ||
  CASE o_orderkey % 4 WHEN 1 THEN '+02:00' WHEN 2 THEN 'Z' ELSE '' END END AS txt FROM orders),
e AS (SELECT o_orderkey, epoch_us(coalesce(TRY_CAST(CASE WHEN regexp_matches(txt, '([+-][0-9]{2}:[0-9]{2}|Z)$') THEN txt ELSE txt || '+05:30' END
  AS TIMESTAMPTZ), TIMESTAMPTZ '1997-06-01 00:00:00+00:00')) // 1000000 AS dl FROM d)
SELECT o_orderkey, CAST(dl AS BIGINT) AS deadline_s, dl <= 852076800 AS past FROM e
""")
def _(t):
    base = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey") % 4
    txt = F.when(k == 0, "not a time").otherwise(
        F.concat(base, F.when(k == 1, "+02:00").when(k == 2, "Z").otherwise(""))
    )
    fallback = "1997-06-01T00:00:00Z"
    at = F.coalesce(T.parse_deadline(txt, "+05:30"), F.lit(fallback).cast("timestamp"))
    return t.orders.select(
        "o_orderkey", F.unix_seconds(at).alias("deadline_s"),
        T.past_deadline(txt, F.timestamp_seconds(F.lit(852076800)), "+05:30", fallback).alias("past"),
    )
