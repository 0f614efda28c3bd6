"""Label text, class vocabularies, tiles and the text sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, rounded
from gridlark.functions import labels as L
from gridlark.operators import remap, tiles
from gridlark.plans import dataset

KEY = ["frame_id", "det_no"]


def _small(t, rows, schema):
    return t.spark.createDataFrame(rows, schema)


def _sized_lines(t):
    """Label lines with the size of their image."""
    sizes = t.images.withColumnRenamed("image_id", "frame_id")
    return t.label_lines.join(sizes, "frame_id")


_CENTRE = """
SELECT l.frame_id, l.det_no, i.width, i.height, l.line, string_split_regex(trim(l.line), '\\s+') AS p, string_split(trim(l.line), ',') AS f
FROM label_lines l JOIN images i ON l.frame_id = i.image_id
"""


@check("parse_box_text", f"""
WITH s AS ({_CENTRE}), k AS (SELECT *, CASE WHEN len(p) = 5 THEN 'centre' WHEN len(f) >= 6 THEN 'pixel' WHEN len(p) >= 9 THEN 'outline' END AS kind FROM s),
n AS (SELECT *, CASE kind WHEN 'centre' THEN TRY_CAST(p[1] AS INT) WHEN 'pixel' THEN TRY_CAST(f[6] AS INT) END AS raw,
  CASE WHEN kind = 'outline' THEN [TRY_CAST(p[1] AS DOUBLE), TRY_CAST(p[3] AS DOUBLE), TRY_CAST(p[5] AS DOUBLE), TRY_CAST(p[7] AS DOUBLE)] END AS xs,
  CASE WHEN kind = 'outline' THEN [TRY_CAST(p[2] AS DOUBLE), TRY_CAST(p[4] AS DOUBLE), TRY_CAST(p[6] AS DOUBLE), TRY_CAST(p[8] AS DOUBLE)] END AS ys FROM k),
r AS (SELECT frame_id, det_no, kind,
  CAST(CASE kind WHEN 'centre' THEN CASE raw WHEN 0 THEN 5 WHEN 1 THEN NULL ELSE raw END
    WHEN 'pixel' THEN CASE raw WHEN 0 THEN 5 END ELSE CASE lower(p[9]) WHEN 'class-0' THEN 7 WHEN 'class-2' THEN 8 END END AS INT) AS cls,
  CASE kind WHEN 'centre' THEN TRY_CAST(p[2] AS DOUBLE) WHEN 'pixel' THEN (TRY_CAST(f[1] AS DOUBLE) + TRY_CAST(f[3] AS DOUBLE) / 2) / width
    ELSE (list_min(xs) + list_max(xs)) / (2.0::DOUBLE * width) END AS xc,
  CASE kind WHEN 'centre' THEN TRY_CAST(p[3] AS DOUBLE) WHEN 'pixel' THEN (TRY_CAST(f[2] AS DOUBLE) + TRY_CAST(f[4] AS DOUBLE) / 2) / height
    ELSE (list_min(ys) + list_max(ys)) / (2.0::DOUBLE * height) END AS yc,
  CASE kind WHEN 'centre' THEN TRY_CAST(p[4] AS DOUBLE) WHEN 'pixel' THEN TRY_CAST(f[3] AS DOUBLE) / width ELSE (list_max(xs) - list_min(xs)) / width END AS bw,
  CASE kind WHEN 'centre' THEN TRY_CAST(p[5] AS DOUBLE) WHEN 'pixel' THEN TRY_CAST(f[4] AS DOUBLE) / height ELSE (list_max(ys) - list_min(ys)) / height END AS bh
  FROM n)
SELECT * FROM r WHERE cls IS NOT NULL AND kind IS NOT NULL
""")
def _(t):
    parsed = L.parse_box_text(
        F.col("line"), F.col("width"), F.col("height"), {0: 5, 1: None}, {"class-0": 7, "class-2": 8}
    )
    rows = _sized_lines(t).select(*KEY, parsed.alias("box")).where("box IS NOT NULL")
    return rows.select(*KEY, "box.*")


@check("parse_box_text_two", f"""
WITH s AS ({_CENTRE}), n AS (SELECT *, CASE WHEN len(p) = 5 THEN TRY_CAST(p[1] AS INT) ELSE CASE lower(p[9]) WHEN 'class-0' THEN 7 ELSE 2 END END AS raw FROM s WHERE len(p) = 5 OR len(p) >= 9)
SELECT frame_id, det_no, CAST(CASE raw WHEN 2 THEN 4 ELSE raw END AS INT) AS cls, round(CASE WHEN len(p) = 5 THEN TRY_CAST(p[2] AS DOUBLE) ELSE (list_min([CAST(p[1] AS DOUBLE), CAST(p[3] AS DOUBLE), CAST(p[5] AS DOUBLE), CAST(p[7] AS DOUBLE)])
  + list_max([CAST(p[1] AS DOUBLE), CAST(p[3] AS DOUBLE), CAST(p[5] AS DOUBLE), CAST(p[7] AS DOUBLE)])) / (2.0::DOUBLE * width) END, 9) AS xc FROM n
""")
def _(t):
    parsed = L.parse_box_text(
        F.col("line"), F.col("width"), F.col("height"), {2: 4}, {"class-0": 7}, csv=False, unknown_default=2
    )
    rows = _sized_lines(t).select(*KEY, parsed.alias("box")).where("box IS NOT NULL")
    return rows.select(*KEY, F.col("box.cls").alias("cls"), rounded("box.xc", 9).alias("xc"))


@check("parse_box_text_lenient", """
WITH s AS (SELECT frame_id, det_no, string_split_regex(trim(line), '\\s+') AS p FROM label_lines),
c AS (SELECT *, CAST(trunc(TRY_CAST(p[1] AS DOUBLE)) AS INT) AS raw FROM s WHERE len(p) >= 5),
m AS (SELECT *, CASE WHEN raw = 0 THEN 9 WHEN raw = 1 THEN 3 ELSE 0 END AS cls FROM c WHERE raw IS NOT NULL)
SELECT frame_id, det_no, array_to_string(list_concat([CAST(cls AS VARCHAR)], p[2:]), ' ') AS line FROM m
""")
def _(t):
    out = L.rewrite_label(F.col("line"), {0: 9, 1: 3}, default_cls=0)
    return t.label_lines.select(*KEY, out.alias("line")).where("line IS NOT NULL")


@check("scan_label_text", "SELECT frame_id, det_no, trim(line) AS line, len(string_split_regex(trim(line), '\\s+')) AS n_tokens FROM label_lines")
def _(t):
    return t.label_lines.select(*KEY, F.trim("line").alias("line"), F.size(L.tokens(F.col("line"))).cast("bigint").alias("n_tokens"))


@check("format_box_text", """
SELECT frame_id, det_no, printf('%d %.6f %.6f %.6f %.6f', class_id, (x1 + x2) / 200, (y1 + y2) / 200, bw / 100, bh / 100) AS line FROM det
""")
def _(t):
    line = L.format_box(
        F.col("class_id"), (F.col("x1") + F.col("x2")) / 200, (F.col("y1") + F.col("y2")) / 200, F.col("bw") / 100, F.col("bh") / 100
    )
    return t.det.select(*KEY, line.alias("line"))


@check("class_remap", """
WITH m(source_idx, raw, target) AS (VALUES (0, 0, 10), (0, 1, 20), (0, 2, NULL), (1, 0, 11), (2, 2, 12))
SELECT d.frame_id, d.det_no, d.source_idx, CAST(m.target AS INT) AS class_id FROM det d JOIN m ON d.source_idx = m.source_idx AND d.class_id = m.raw
WHERE m.target IS NOT NULL
""")
def _(t):
    m = _small(t, [(0, "0", 10), (0, "1", 20), (0, "2", None), (1, "0", 11), (2, "2", 12)], "source_idx int, raw string, target int")
    return remap.remap_classes(t.det, m, source_key="source_idx").select(*KEY, "source_idx", "class_id")


@check("class_remap_default", """
SELECT frame_id, det_no, CAST(CASE class_id WHEN 0 THEN 10 ELSE 99 END AS INT) AS class_id FROM det WHERE class_id <> 2
""")
def _(t):
    m = _small(t, [(0, 10), (2, None)], "raw int, target int")
    return remap.remap_classes(t.det, m, "default", 99).select(*KEY, "class_id")


@check("class_remap_keep", """
SELECT frame_id, det_no, CAST(CASE class_id WHEN 0 THEN 10 ELSE class_id END AS INT) AS class_id FROM det WHERE class_id <> 2
""")
def _(t):
    m = _small(t, [(0, 10), (2, None)], "raw int, target int")
    return remap.remap_classes(t.det, m, "keep").select(*KEY, "class_id")


@check("name_normalise", """
SELECT p_partkey, trim(translate(lower('  ' || upper(p_name) || '-' || p_type || '_x '), '-_', '  ')) AS name FROM part
""")
def _(t):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("-"), "p_type", F.lit("_x "))
    return t.part.select("p_partkey", L.normalise_name(raw).alias("name"))


RULES = [(("ring", "gear"), 4), (("red", "blu"), 1), (("widget",), 2), (("small", "large"), 3)]


@check("name_keyword_map", """
WITH n AS (SELECT p_partkey, trim(translate(lower(p_name), '-_', '  ')) AS n FROM part),
m AS (SELECT p_partkey, CAST(CASE WHEN n IN ('red ring', 'small bolt') THEN NULL WHEN contains(n, 'ring') OR contains(n, 'gear') THEN 4
  WHEN contains(n, 'red') OR contains(n, 'blu') THEN 1 WHEN contains(n, 'widget') THEN 2
  WHEN contains(n, 'small') OR contains(n, 'large') THEN 3 END AS INT) AS cls FROM n)
SELECT * FROM m WHERE cls IS NOT NULL
""")
def _(t):
    cls = L.keyword_class(F.col("p_name"), RULES, stop=("red ring", "small bolt"))
    return t.part.select("p_partkey", cls.alias("cls")).where("cls IS NOT NULL")


def _paths(t):
    """Image paths in several folder layouts, one per order."""
    k = F.col("image_id")
    folder = F.element_at(
        F.array(*[F.lit(s) for s in ("images/train", "images/val", "images/valid", "valid/images", "test/images", "train/images")]),
        (k % 6 + 1).cast("int"),
    )
    return t.images.select("image_id", F.concat(F.lit("root/"), folder, F.lit("/img_"), k, F.lit(".jpg")).alias("path"))


_PATHS = """paths AS (SELECT image_id, 'root/' || (['images/train', 'images/val', 'images/valid', 'valid/images', 'test/images', 'train/images'])[image_id % 6 + 1]
  || '/img_' || image_id || '.jpg' AS path FROM images)"""


@check("split_folder_alias", f"""
WITH {_PATHS}
SELECT image_id, CASE WHEN image_id % 6 IN (1, 2, 3, 4) THEN 'val' ELSE 'train' END AS split, 'img_' || image_id AS stem FROM paths
""")
def _(t):
    return _paths(t).select("image_id", L.split_of_folder(F.col("path")).alias("split"), L.file_stem(F.col("path")).alias("stem"))


@check("log_error_flag", """
SELECT doc_id, contains(t, 'error') OR contains(t, 'the re') OR contains(t, 'ment') AS flagged FROM (SELECT doc_id, lower(right(text, 2000)) AS t FROM documents)
""")
def _(t):
    return t.documents.select("doc_id", L.has_error(F.col("text"), ("error", "the re", "ment")).alias("flagged"))


_GRID = """starts AS (SELECT image_id, width, height,
    list_distinct(list_concat(range(0, greatest(1, width - 640), 512), CASE WHEN (greatest(1, width - 640) - 1) // 512 * 512 + 640 < width THEN [greatest(0, width - 640)::BIGINT] ELSE [] END)) AS xs,
    list_distinct(list_concat(range(0, greatest(1, height - 640), 512), CASE WHEN (greatest(1, height - 640) - 1) // 512 * 512 + 640 < height THEN [greatest(0, height - 640)::BIGINT] ELSE [] END)) AS ys
  FROM images),
ex AS (SELECT image_id, width, height, unnest(xs) AS x0, ys FROM starts), ey AS (SELECT image_id, width, height, x0, unnest(ys) AS y0 FROM ex),
wins AS (SELECT image_id, width, height, CAST(greatest(0, least(width, x0 + 640) - 640) AS INT) AS tx1, CAST(greatest(0, least(height, y0 + 640) - 640) AS INT) AS ty1,
  CAST(least(width, x0 + 640) AS INT) AS tx2, CAST(least(height, y0 + 640) AS INT) AS ty2, width <= 640 AND height <= 640 AS whole FROM ey)"""


@check("tile_grid", f"WITH {_GRID} SELECT image_id, tx1, ty1, tx2, ty2, whole FROM wins")
def _(t):
    return tiles.tile_grid(t.images, 640, 0.2).select("image_id", "tx1", "ty1", "tx2", "ty2", "whole")


@check("tile_name", f"""
WITH {_GRID} SELECT image_id, tx1, ty1, CASE WHEN whole THEN 'img_' || image_id ELSE 'img_' || image_id || '_tile_' || ty1 || '_' || tx1 END AS name FROM wins
""")
def _(t):
    stem = F.concat(F.lit("img_"), "image_id")
    return tiles.tile_grid(t.images, 640, 0.2).select("image_id", "tx1", "ty1", tiles.tile_name(stem).alias("name"))


_BOXES = """nb AS (SELECT frame_id AS image_id, det_no, class_id, (x1 + x2) / 2 / 100 AS xc, (y1 + y2) / 2 / 75 AS yc, bw / 100 AS bw, bh / 75 AS bh FROM det),
px AS (SELECT n.image_id, n.det_no, n.class_id, n.xc, n.yc, n.bw, n.bh, i.width, i.height, (n.xc - n.bw / 2) * i.width AS bx1, (n.yc - n.bh / 2) * i.height AS by1,
  (n.xc + n.bw / 2) * i.width AS bx2, (n.yc + n.bh / 2) * i.height AS by2 FROM nb n JOIN images i ON n.image_id = i.image_id)"""


def _norm_boxes(t):
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return t.det.select(
        F.col("frame_id").alias("image_id"), "det_no", "class_id",
        ((x1 + x2) / 2 / 100).alias("xc"), ((y1 + y2) / 2 / 75).alias("yc"),
        (F.col("bw") / 100).alias("bw"), (F.col("bh") / 75).alias("bh"),
    )


@check("tile_project", f"""
WITH {_GRID}, {_BOXES},
j AS (SELECT p.*, w.tx1, w.ty1, w.tx2, w.ty2, w.whole, greatest(bx1, tx1) AS ix1, greatest(by1, ty1) AS iy1, least(bx2, tx2) AS ix2, least(by2, ty2) AS iy2
  FROM px p JOIN wins w ON p.image_id = w.image_id),
v AS (SELECT *, greatest(0, ix2 - ix1) * greatest(0, iy2 - iy1) AS inter, greatest(0, bx2 - bx1) * greatest(0, by2 - by1) AS orig FROM j),
o AS (SELECT image_id, det_no, class_id, tx1, ty1, CASE WHEN whole THEN xc ELSE ((ix1 + ix2) / 2 - tx1) / CAST(tx2 - tx1 AS DOUBLE) END AS txc,
  CASE WHEN whole THEN yc ELSE ((iy1 + iy2) / 2 - ty1) / CAST(ty2 - ty1 AS DOUBLE) END AS tyc,
  CASE WHEN whole THEN bw ELSE (ix2 - ix1) / CAST(tx2 - tx1 AS DOUBLE) END AS tbw, CASE WHEN whole THEN bh ELSE (iy2 - iy1) / CAST(ty2 - ty1 AS DOUBLE) END AS tbh,
  whole FROM v WHERE whole OR (orig > 0 AND inter / orig >= 0.3))
SELECT image_id, det_no, class_id, tx1, ty1, round(txc, 9) AS xc, round(tyc, 9) AS yc, round(tbw, 9) AS bw, round(tbh, 9) AS bh FROM o WHERE whole OR (tbw > 0.005 AND tbh > 0.005)
""")
def _(t):
    out = tiles.tile_project(t.images, _norm_boxes(t), 640, 0.2)
    return out.select("image_id", "det_no", "class_id", "tx1", "ty1", *[rounded(c, 9).alias(c) for c in ("xc", "yc", "bw", "bh")])


@check("tile_project_fixed", f"""
WITH {_GRID}, {_BOXES},
j AS (SELECT p.*, w.tx1, w.ty1, w.tx2, w.ty2, w.whole, greatest(bx1, tx1) AS ix1, greatest(by1, ty1) AS iy1, least(bx2, tx2) AS ix2, least(by2, ty2) AS iy2
  FROM px p JOIN wins w ON p.image_id = w.image_id)
SELECT image_id, det_no, class_id, tx1, ty1, round(CASE WHEN whole THEN xc ELSE ((ix1 + ix2) / 2 - tx1) / 640.0::DOUBLE END, 9) AS xc,
  round(CASE WHEN whole THEN yc ELSE ((iy1 + iy2) / 2 - ty1) / 640.0::DOUBLE END, 9) AS yc, round(CASE WHEN whole THEN bw ELSE (ix2 - ix1) / 640.0::DOUBLE END, 9) AS bw,
  round(CASE WHEN whole THEN bh ELSE (iy2 - iy1) / 640.0::DOUBLE END, 9) AS bh
FROM j WHERE whole OR (ix2 > ix1 AND iy2 > iy1 AND (ix2 - ix1) * (iy2 - iy1) / greatest(1.0::DOUBLE, (bx2 - bx1) * (by2 - by1)) >= 0.3)
""")
def _(t):
    out = tiles.tile_project(t.images, _norm_boxes(t), 640, 0.2, fixed=True, min_step=32)
    return out.select("image_id", "det_no", "class_id", "tx1", "ty1", *[rounded(c, 9).alias(c) for c in ("xc", "yc", "bw", "bh")])


@check("prepare_dataset", f"""
WITH {_PATHS}, s AS (SELECT l.frame_id, l.det_no, string_split_regex(trim(l.line), '\\s+') AS p FROM label_lines l),
m AS (SELECT frame_id, det_no, CAST(trunc(TRY_CAST(p[1] AS DOUBLE)) AS INT) AS raw, p FROM s WHERE len(p) >= 5),
r AS (SELECT frame_id, det_no, array_to_string(list_concat([CAST(CASE raw WHEN 0 THEN 9 WHEN 1 THEN 3 END AS VARCHAR)], p[2:]), ' ') AS line FROM m WHERE raw IN (0, 1)),
g AS (SELECT frame_id, string_agg(line, chr(10) ORDER BY det_no) || chr(10) AS text, count(*) AS n FROM r GROUP BY frame_id)
SELECT CASE WHEN image_id % 6 IN (1, 2, 3, 4) THEN 'val' ELSE 'train' END AS split, 'set_img_' || image_id AS stem, coalesce(n, 0) AS kept, coalesce(text, '') AS text
FROM paths p LEFT JOIN g ON p.image_id = g.frame_id
""")
def _(t):
    files = _paths(t).select(F.col("image_id").alias("frame_id"), F.regexp_replace(F.regexp_replace("path", "images", "labels"), "jpg$", "txt").alias("path"))
    lines = t.label_lines.join(files, "frame_id").select("path", F.col("det_no").alias("line_no"), "line")
    return dataset.prepare(_paths(t).select("path"), lines, "set", {0: 9, 1: 3}).select("split", "stem", "kept", "text")
