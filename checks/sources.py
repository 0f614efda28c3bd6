"""Readers and sinks over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, rounded
from gridlark.operators import remap
from gridlark.sources import images, readers, sinks

KEY = ["frame_id", "det_no"]


@check("scan_images", """
SELECT 'raw/' || (o_orderkey % 9) || '/f' || (o_orderkey // 2) || CASE o_orderkey % 4 WHEN 0 THEN '.JPG' WHEN 2 THEN '.png' END AS path FROM orders WHERE o_orderkey % 4 IN (0, 2)
""")
def _(t):
    k = F.col("o_orderkey")
    ext = F.when(k % 4 == 0, ".JPG").when(k % 4 == 1, ".txt").when(k % 4 == 2, ".png").otherwise(".mp4")
    files = t.orders.select(F.concat(F.lit("raw/"), k % 9, F.lit("/f"), F.floor(k / 2), ext).alias("path"))
    return readers.pick_images(files.unionByName(files))


# Five kinds of header around the size of each image; the rest of the files is broken or missing.
_BROKEN = "image_id % 7 > 4"


@check("scan_image_size", f"""
SELECT image_id, CASE WHEN {_BROKEN} THEN 640 ELSE height END AS height, CASE WHEN {_BROKEN} THEN 640 ELSE width END AS width,
  CASE image_id % 7 WHEN 5 THEN 'UNREADABLE unknown format' WHEN 6 THEN 'UNREADABLE cut short' ELSE 'OK' END AS status FROM images
""")
def _(t):
    big = lambda c, n: F.lpad(F.hex(F.col(c)), 2 * n, "0")

    def little(c, n):
        text = big(c, n)
        return F.concat(*[F.substring(text, 2 * k + 1, 2) for k in range(n - 1, -1, -1)])

    segment = "FFD8FFE00010" + "4A46494600010100000100010000" + "FFFE0004C0C0" + "FFC2001108"
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big("width", 4), big("height", 4), F.lit("0806000000"))
    jpeg = F.concat(F.lit(segment), big("height", 2), big("width", 2), F.lit("03"))
    bmp = F.concat(F.lit("424D" + "00" * 12 + "28000000"), little("width", 4), little("height", 4))
    gif = F.concat(F.lit("474946383961"), little("width", 2), little("height", 2))
    entry = lambda tag, c: F.concat(F.lit(tag + "0400" + "01000000"), little(c, 4))
    tiff = F.concat(F.lit("49492A00080000000200"), entry("0001", "width"), entry("0101", "height"))
    kinds = [png, jpeg, bmp, gif, tiff, F.lit("00112233"), F.substring(png, 1, 40)]
    content = F.unhex(F.element_at(F.array(*kinds), (F.col("image_id") % 7 + 1).cast("int")))
    return images.header_sizes(t.images.select("image_id", content.alias("content")))


@check("scan_csv_boxes", """
WITH c AS (SELECT frame_id, det_no, class_id, CASE WHEN det_no % 5 = 0 THEN NULL ELSE x1 / 100 END AS a, x2 / 100 AS b, y1 / 75 AS c, CASE WHEN det_no % 7 = 3 THEN y1 / 75 ELSE y2 / 75 END AS d FROM det)
SELECT CAST(frame_id AS VARCHAR) AS image_id, '/m/' || class_id AS mid, round((a + b) / 2, 9) AS xc, round((c + d) / 2, 9) AS yc, round(greatest(0, b - a), 9) AS w, round(greatest(0, d - c), 9) AS h
FROM c WHERE a IS NOT NULL AND b - a > 0 AND d - c > 0
""")
def _(t):
    bottom = F.when(F.col("det_no") % 7 == 3, F.col("y1") / 75).otherwise(F.col("y2") / 75)
    left = F.when(F.col("det_no") % 5 == 0, F.lit("n/a")).otherwise((F.col("x1") / 100).cast("string"))
    line = F.concat_ws(",", "frame_id", F.concat(F.lit("/m/"), "class_id"), left, F.col("x2") / 100, F.col("y1") / 75, bottom)
    names = ["ImageID", "LabelName", "XMin", "XMax", "YMin", "YMax"]
    boxes = readers.typed_csv_boxes(readers.csv_columns(t.det.select(line.alias("line")), "line", names))
    return boxes.select("image_id", "mid", *[rounded(c, 9).alias(c) for c in ("xc", "yc", "w", "h")])


@check("scan_sequence", """
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY 'f' || doc_id) - 1 AS frame_index FROM documents
""")
def _(t):
    files = t.documents.select("source", "doc_id", F.concat(F.lit("f"), "doc_id").alias("name"))
    return readers.sequence_frames(files, ["source"]).select("source", "doc_id", "frame_index")


@check("scan_names", """
SELECT CAST(row_number() OVER (ORDER BY n_nationkey * 3) - 1 AS INT) AS id, n_name AS name FROM nation
""")
def _(t):
    names = t.nation.select((F.col("n_nationkey") * 3).cast("string").alias("key"), F.col("n_name").alias("name"))
    return remap.ordered_names(names)


def _log(t):
    frames = t.orders.select(
        F.col("o_orderkey").alias("frame"), (F.col("o_orderkey") / 30.0).alias("timestamp"), (F.col("o_orderstatus") == "F").alias("triggered")
    )
    det = t.det.select(F.col("frame_id").alias("frame"), "det_no", F.col("x1").cast("int").alias("x1"), "class_id")
    trk = t.tracks.where("confirmed").select(F.col("frame_index").alias("frame"), "track_id", "hits")
    return sinks.frame_log(frames, det, trk, ["frame"], "det_no", "track_id")


@check("sink_jsonl", """
WITH d AS (SELECT frame_id AS frame, string_agg('{"det_no":' || det_no || ',"x1":' || CAST(x1 AS INT) || ',"class_id":' || class_id || '}', ',' ORDER BY det_no) AS j FROM det GROUP BY 1),
k AS (SELECT frame_index AS frame, string_agg('{"track_id":' || track_id || ',"hits":' || hits || '}', ',' ORDER BY track_id) AS j FROM tracks WHERE confirmed GROUP BY 1)
SELECT o_orderkey AS frame, '{"frame":' || o_orderkey || ',"triggered":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || ',"detections":[' || coalesce(d.j, '') || '],"tracks":[' || coalesce(k.j, '') || ']}' AS json
FROM orders LEFT JOIN d ON o_orderkey = d.frame LEFT JOIN k ON o_orderkey = k.frame
""")
def _(t):
    row = F.struct("frame", "triggered", "detections", "tracks")
    return _log(t).select("frame", F.to_json(row).alias("json"))


@check("sink_label_text", """
WITH l AS (SELECT frame_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, (x1 + x2) / 200, (y1 + y2) / 200, bw / 100, bh / 100), chr(10) ORDER BY det_no) || chr(10) AS text FROM det GROUP BY 1)
SELECT image_id, coalesce(text, '') AS text FROM images LEFT JOIN l ON image_id = frame_id
""")
def _(t):
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    boxes = t.det.select(
        F.col("frame_id").alias("image_id"), "det_no", "class_id", ((x1 + x2) / 200).alias("xc"), ((y1 + y2) / 200).alias("yc"),
        (F.col("bw") / 100).alias("bw"), (F.col("bh") / 100).alias("bh"),
    )
    return sinks.label_files(t.images.select("image_id"), boxes, "image_id", "det_no").select("image_id", "text")


@check("sink_manifest", """
SELECT 'data/set' AS path, 'images/train' AS train, 'images/val' AS val, count(*) AS nc, '{' || string_agg('"' || n_nationkey || '":"' || n_name || '"', ',' ORDER BY n_nationkey) || '}' AS names FROM nation
""")
def _(t):
    names = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return sinks.manifest(names, "data/set", ["train", "val"]).withColumn("names", F.to_json("names"))
