"""Splits, quotas, chunks, de-duplication and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from gridlark.operators import sampling as S
from gridlark.sources import state

KEY = ["frame_id", "det_no"]


@check("sample_stride", "SELECT stream_id, frame_index, z FROM series WHERE frame_index % 5 = 0")
def _(t):
    return S.every_nth(t.series, "frame_index", 5).select("stream_id", "frame_index", "z")


@check("sample_cap", """
SELECT path, priority FROM (SELECT 'f' || o_orderkey AS path, CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS INT) AS priority FROM orders) ORDER BY priority, path LIMIT 400
""")
def _(t):
    media = t.orders.select(
        F.concat(F.lit("f"), "o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("priority")
    )
    return S.capped(media, ["priority", "path"], 400)


@check("split_shuffle", """
SELECT image_id, CASE WHEN n <= floor(c * 0.8::DOUBLE) THEN 'train' WHEN n <= floor(c * 0.8::DOUBLE) + floor(c * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT image_id, row_number() OVER (ORDER BY md5(image_id || ':42'), image_id) AS n, count(*) OVER () AS c FROM images)
""")
def _(t):
    return S.shuffle_split(t.images, "image_id", 0.8, 0.15, 0.05).select("image_id", "split")


@check("split_modulo", """
SELECT path, CASE WHEN (row_number() OVER (ORDER BY path) - 1) % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT 'img_' || image_id || '.jpg' AS path FROM images)
""")
def _(t):
    paths = t.images.select(F.concat(F.lit("img_"), "image_id", F.lit(".jpg")).alias("path"))
    return S.modulo_split(paths, ["path"], 10)


@check("val_fallback", """
SELECT path, CASE WHEN (row_number() OVER (ORDER BY path) - 1) % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT 'a' || o_orderkey AS path FROM orders)
""")
def _(t):
    rows = t.orders.select(F.concat(F.lit("a"), "o_orderkey").alias("path"), F.lit("train").alias("split"))
    return S.val_fallback(rows, ["path"])


@check("min_rows_check", "SELECT count(*) AS rows FROM images")
def _(t):
    return S.require_rows(t.images, 20, "training images")


@check("sample_quota", """
WITH h AS (SELECT DISTINCT frame_id, class_id FROM det),
p1 AS (SELECT frame_id FROM h WHERE class_id = 2 ORDER BY frame_id LIMIT 300),
c0 AS (SELECT greatest(0, 350 - count(*)) AS room FROM h JOIN p1 USING (frame_id) WHERE class_id = 0),
p2 AS (SELECT frame_id FROM (SELECT frame_id, row_number() OVER (ORDER BY frame_id) AS n FROM h WHERE class_id = 0 AND frame_id NOT IN (SELECT frame_id FROM p1)) WHERE n <= (SELECT room FROM c0)),
t2 AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
c1 AS (SELECT greatest(0, 500 - count(*)) AS room FROM h JOIN t2 USING (frame_id) WHERE class_id = 1),
p3 AS (SELECT frame_id FROM (SELECT frame_id, row_number() OVER (ORDER BY frame_id) AS n FROM h WHERE class_id = 1 AND frame_id NOT IN (SELECT frame_id FROM t2)) WHERE n <= (SELECT room FROM c1))
SELECT frame_id FROM t2 UNION ALL SELECT frame_id FROM p3
""")
def _(t):
    return S.quota_sample(t.det, "frame_id", "class_id", [(2, 300), (0, 350), (1, 500)])


@check("chunk_by_size", """
WITH RECURSIVE lists AS (SELECT grp, list(seq ORDER BY seq) AS ids, list(size ORDER BY seq) AS sizes FROM sized_items GROUP BY grp),
walk AS (SELECT grp, ids, sizes, 0 AS i, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS acc, CAST(NULL AS BIGINT) AS seq FROM lists UNION ALL
  SELECT grp, ids, sizes, i + 1, CASE WHEN acc >= 9000 THEN chunk + 1 ELSE chunk END, CASE WHEN acc >= 9000 THEN sizes[i + 1] ELSE acc + sizes[i + 1] END, ids[i + 1]
  FROM walk WHERE i < len(ids))
SELECT grp, seq, chunk FROM walk WHERE i > 0
""")
def _(t):
    return S.chunk_by_size(t.sized_items, "grp", ["seq"], "size", 9000).select("grp", "seq", "chunk")


@check("round_robin", """
WITH q AS (SELECT r_name AS item, row_number() OVER (ORDER BY r_regionkey) - 1 AS slot, count(*) OVER () AS n FROM region)
SELECT o.o_orderkey, q.item FROM (SELECT o_orderkey, (3 + row_number() OVER (ORDER BY o_orderkey) - 1) % (SELECT count(*) FROM region) AS slot FROM orders) o JOIN q USING (slot)
""")
def _(t):
    queue = t.region.select(F.col("r_regionkey").alias("position"), F.col("r_name").alias("item"))
    return S.round_robin(t.orders.select("o_orderkey"), queue, ["o_orderkey"], base=3).select("o_orderkey", "item")


@check("curriculum_union", """
SELECT frame_id, det_no, class_id AS stage FROM det WHERE class_id <= 1
""")
def _(t):
    stages = [t.det.where(F.col("class_id") == k).select(*KEY) for k in range(3)]
    return S.staged_union(stages, 1)


@check("union_sources", """
SELECT 'shop_' || c_custkey AS stem, 'shop' AS source FROM customer UNION ALL SELECT 'mill_' || s_suppkey, 'mill' FROM supplier
""")
def _(t):
    return S.union_sources(
        {"shop": t.customer.select(F.col("c_custkey").cast("string").alias("stem")), "mill": t.supplier.select(F.col("s_suppkey").cast("string").alias("stem"))},
        "stem",
    )


@check("dedup_first", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1
""")
def _(t):
    rows = t.events.select("user_id", "event_type", "event_id", "value")
    return S.first_per_key(rows, ["user_id", "event_type"], ["event_id"])


@check("state_skip_done", """
SELECT CAST(l_orderkey AS BIGINT) AS ref, l_partkey AS tag FROM lineitem WHERE l_orderkey NOT IN (SELECT ref FROM done_refs) AND l_partkey NOT IN (SELECT ref FROM done_refs)
""")
def _(t):
    work = t.lineitem.select(F.col("l_orderkey").alias("ref"), F.col("l_partkey").alias("tag"))
    return state.skip_done(work, t.done_refs)


@check("state_merge", """
WITH s AS (SELECT o_custkey AS key, o_orderpriority AS value, o_orderkey AS version FROM orders)
SELECT key, arg_max(value, version) AS value, max(version) AS version FROM s GROUP BY key
""")
def _(t):
    rows = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("version"))
    return state.merge_state(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"))


@check("source_status", """
SELECT 'shop' AS source, 'OK' AS status, (SELECT count(*) FROM customer) AS images UNION ALL SELECT 'mill', 'OK', (SELECT count(*) FROM supplier)
UNION ALL SELECT 'attic', 'UNKNOWN_SOURCE', NULL UNION ALL SELECT 'broken', 'FAILED OSError', NULL
""")
def _(t):
    def broken():
        raise OSError("folder is gone")

    loaders = {"shop": lambda: t.customer, "mill": lambda: t.supplier, "broken": broken}
    return state.source_status(t.spark, ["shop", "mill", "attic", "broken"], loaders)[0]
