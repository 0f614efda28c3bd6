"""Aggregates, grids, clusters and consensus boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, rounded
from gridlark.operators import components, fusion, grids, metrics, sampling

KEY = ["frame_id", "det_no"]


def r6(c, name=None, digits=6):
    return rounded(c, digits).alias(name or c)


@check("agg_run_summary", """
SELECT event_type AS run, count(*) AS frames, count(*) FILTER (WHERE value < 10) AS skipped, count(*) FILTER (WHERE value >= 30) AS inferred FROM events GROUP BY 1
""")
def _(t):
    frames = t.events.select(F.col("event_type").alias("run"), (F.col("value") < 10).alias("skipped"), (F.col("value") >= 30).alias("inferred"))
    return metrics.run_summary(frames, ["run"])


@check("agg_split_counts", """
SELECT CASE WHEN image_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS images FROM images GROUP BY 1
""")
def _(t):
    split = F.when(F.col("image_id") % 10 == 0, "val").otherwise("train")
    return sampling.split_counts(t.images.withColumn("split", split))


@check("agg_dir_size", "SELECT source AS folder, sum(n_chars) / 1073741824.0::DOUBLE AS gb, count(*) AS files FROM documents GROUP BY 1")
def _(t):
    from gridlark.sources.readers import folder_sizes

    return folder_sizes(t.documents.select(F.col("source").alias("folder"), F.col("n_chars").alias("length")), ["folder"])


@check("agg_percentiles", """
SELECT run, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.9), 6) AS p90,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99,
  round(CASE WHEN avg(latency_ms) > 0 THEN 1000 / avg(latency_ms) ELSE 0 END, 6) AS fps FROM latencies GROUP BY run
""")
def _(t):
    out = metrics.latency_summary(t.latencies, ["run"], "latency_ms")
    return out.select("run", *[r6(c) for c in ("mean_ms", "p50", "p90", "p95", "p99", "fps")])


@check("agg_scale_factor", "SELECT round(127 / greatest(quantile_cont(abs(value - 30), 0.9999), 1e-4), 6) AS scale FROM events")
def _(t):
    return metrics.scale_factor(t.events.select((F.col("value") - 30).alias("v")), "v").select(r6("scale"))


_FUSE = """WITH RECURSIVE nb AS (SELECT frame_id, class_id, least(greatest(x1 / 100, 0), 1) AS x1, least(greatest(y1 / 75, 0), 1) AS y1,
  least(greatest(x2 / 100, 0), 1) AS x2, least(greatest(y2 / 75, 0), 1) AS y2, conf * [1.0::DOUBLE, 1.2::DOUBLE, 1.1::DOUBLE][source_idx + 1] AS s FROM det WHERE conf >= 0.35),
lists AS (SELECT frame_id, class_id, list({s: s, x1: x1, y1: y1, x2: x2, y2: y2} ORDER BY s DESC, x1, y1, x2, y2) AS b FROM nb WHERE x2 > x1 AND y2 > y1 GROUP BY 1, 2),
walk AS (SELECT frame_id, class_id, b, 1 AS i, CAST([] AS STRUCT(n BIGINT, sw DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE)[]) AS st FROM lists UNION ALL
 SELECT frame_id, class_id, b, i + 1, CASE WHEN len(st) > 0 AND list_max(ious) > 0.55
   THEN list_transform(st, lambda c, k: CASE WHEN k = list_position(ious, list_max(ious)) THEN
     {n: c.n + 1, sw: c.sw + r.s, a: c.a + r.s * r.x1, b: c.b + r.s * r.y1, c: c.c + r.s * r.x2, d: c.d + r.s * r.y2} ELSE c END)
   ELSE list_append(st, {n: 1::BIGINT, sw: r.s, a: r.s * r.x1, b: r.s * r.y1, c: r.s * r.x2, d: r.s * r.y2}) END
 FROM (SELECT *, list_transform(inter, lambda v, k: v / ((st[k].c - st[k].a) * (st[k].d - st[k].b) / (st[k].sw * st[k].sw) + (r.x2 - r.x1) * (r.y2 - r.y1) - v)) AS ious
   FROM (SELECT *, list_transform(st, lambda c: greatest(0, least(c.c / c.sw, r.x2) - greatest(c.a / c.sw, r.x1)) * greatest(0, least(c.d / c.sw, r.y2) - greatest(c.b / c.sw, r.y1))) AS inter
     FROM (SELECT *, b[i] AS r FROM walk WHERE i <= len(b)) q) q2) q3),
fused AS (SELECT frame_id, class_id, unnest(st) AS c FROM walk WHERE i = len(b) + 1)"""


@check("agg_box_fusion", _FUSE + """
SELECT frame_id, class_id, c.n AS n_members, round(c.sw / c.n * least(3, c.n) / 3.3::DOUBLE, 6) AS confidence, round(c.a / c.sw, 6) AS x1, round(c.b / c.sw, 6) AS y1,
  round(c.c / c.sw, 6) AS x2, round(c.d / c.sw, 6) AS y2 FROM fused
""")
def _(t):
    out = fused_boxes(t)
    return out.select("frame_id", "class_id", "n_members", *[r6(c) for c in ("confidence", "x1", "y1", "x2", "y2")])


def fused_boxes(t):
    shares = t.det.withColumns({c: F.col(c) / (100 if c[0] == "x" else 75) for c in ("x1", "y1", "x2", "y2")})
    return fusion.fuse_boxes(shares, ["frame_id"], [1.0, 1.2, 1.1])


@check("agg_boxes_total", _FUSE + " SELECT count(*) AS boxes FROM fused")
def _(t):
    return fused_boxes(t).agg(F.count("*").alias("boxes"))


@check("consensus_labels", _FUSE.replace("FROM det WHERE conf >= 0.35", "FROM det WHERE conf >= 0.35 AND (source_idx, class_id) <> (1, 2)") + """,
n AS (SELECT frame_id, count(*) AS n FROM fused GROUP BY 1)
SELECT image_id, coalesce(n, 0) AS n_labels, CASE WHEN k <= floor(c * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(c * 0.8::DOUBLE) + floor(c * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT o_orderkey AS image_id, row_number() OVER (ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS k, count(*) OVER () AS c FROM orders) i LEFT JOIN n ON image_id = frame_id
""")
def _(t):
    from gridlark.plans.labelling import consensus_labels

    images = t.orders.select(F.col("o_orderkey").alias("image_id"), F.lit(100).alias("width"), F.lit(75).alias("height"))
    rows = [(s, str(c), None if (s, c) == (1, 2) else c + 10) for s in range(3) for c in range(3)]
    class_map = t.spark.createDataFrame(rows, "source_idx int, raw string, target int")
    boxes = t.det.withColumnRenamed("frame_id", "image_id")
    return consensus_labels(images, boxes, class_map, [1.0, 1.2, 1.1]).select("image_id", "n_labels", "split")


@check("agg_boxes_by_image", """
SELECT frame_id, count(*) AS n_boxes, string_agg(class_id || ':' || CAST(CAST(x1 AS BIGINT) AS VARCHAR), ';' ORDER BY det_no) AS boxes FROM det GROUP BY 1
""")
def _(t):
    return sampling.boxes_by_image(t.det, ["frame_id"], "det_no", F.concat_ws(":", "class_id", F.col("x1").cast("bigint")))


@check("agg_class_counts", "SELECT class_id, count(DISTINCT frame_id) AS n_images FROM det GROUP BY 1")
def _(t):
    return metrics.class_image_counts(t.det, "frame_id", "class_id")


@check("scan_grid_cube", "SELECT map_id, r, d, abs(5 - mag) AS mag FROM grid_cells")
def _(t):
    signed = t.grid_cells.withColumn("mag", 5 - F.col("mag"))
    return grids.magnitudes(signed)


@check("agg_grid_energy", """
SELECT map_id, round(avg(mag) + max(mag) * 0.05, 6) AS energy, round(avg(mag), 6) AS light FROM grid_cells GROUP BY 1
""")
def _(t):
    full = grids.cheap_energy(t.grid_cells)
    light = grids.cheap_energy(t.grid_cells, light=True).withColumnRenamed("energy", "light")
    return full.join(light, "map_id").select("map_id", r6("energy"), r6("light"))


@check("agg_row_profile", "SELECT map_id, r, round(avg(mag), 6) AS profile FROM grid_cells GROUP BY 1, 2")
def _(t):
    return grids.row_profile(t.grid_cells).select("map_id", "r", r6("profile"))


def _kernel(sigma, radius):
    return f"(SELECT o, exp(-0.5 * (o / {sigma}) ** 2) / (SELECT sum(exp(-0.5 * (p / {sigma}) ** 2)) FROM range(-{radius}, {radius + 1}) q(p)) AS w FROM range(-{radius}, {radius + 1}) k(o))"


def _smooth_sql(n, sigma, radius):
    mirror = lambda i: f"CASE WHEN ((({i}) % 20) + 20) % 20 < 10 THEN ((({i}) % 20) + 20) % 20 ELSE 19 - ((({i}) % 20) + 20) % 20 END"
    return f"""a{n} AS (SELECT g.map_id, g.r, g.d, sum(k.w * h.mag) AS v FROM grid_cells g, {_kernel(sigma, radius)} k, grid_cells h
  WHERE h.map_id = g.map_id AND h.r = g.r AND h.d = {mirror('g.d + k.o')} GROUP BY 1, 2, 3),
l{n} AS (SELECT g.map_id, g.r, g.d, sum(k.w * h.v) AS v FROM grid_cells g, {_kernel(sigma, radius)} k, a{n} h
  WHERE h.map_id = g.map_id AND h.d = g.d AND h.r = {mirror('g.r + k.o')} GROUP BY 1, 2, 3)"""


_LAYERS = ",\n".join(_smooth_sql(n, s, r) for n, s, r in ((0, "1.0::DOUBLE", 4), (1, "2.0::DOUBLE", 8), (2, "4.0::DOUBLE", 16)))
_LAYERS += ",\nlayers AS (SELECT a.map_id, a.r, a.d, a.v AS s0, b.v AS s1, c.v AS s2 FROM l0 a JOIN l1 b USING (map_id, r, d) JOIN l2 c USING (map_id, r, d))"


@check("grid_smooth", f"WITH {_LAYERS} SELECT map_id, r, d, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM layers")
def _(t):
    return grids.smooth(t.grid_cells).select("map_id", "r", "d", r6("s0"), r6("s1"), r6("s2"))


@check("win_local_max", """
WITH b AS (SELECT g.map_id, g.r, g.d, any_value(g.mag) AS mag, max(h.mag) AS box FROM grid_cells g JOIN grid_cells h
  ON g.map_id = h.map_id AND abs(g.r - h.r) <= 1 AND abs(g.d - h.d) <= 1 GROUP BY 1, 2, 3),
m AS (SELECT map_id, max(mag) AS top, max(r) AS rr, max(d) AS dd FROM grid_cells GROUP BY 1)
SELECT b.map_id, b.r, b.d, b.mag FROM b JOIN m USING (map_id) WHERE b.r BETWEEN 1 AND rr - 1 AND b.d BETWEEN 1 AND dd - 1 AND mag >= 0.35 * (top + 1e-6) AND mag >= box
""")
def _(t):
    return grids.local_maxima(t.grid_cells, "mag").select("map_id", "r", "d", "mag")


@check("topk_peaks", """
SELECT map_id, r, d, mag, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY map_id ORDER BY mag DESC, r, d) AS INT) AS rank FROM grid_cells) WHERE rank <= 8
""")
def _(t):
    return grids.top_peaks(t.grid_cells, "mag").select("map_id", "r", "d", "mag", "rank")


_PEAKS = _LAYERS + """,
q AS (SELECT map_id, r, d, round(s0, 9) AS f0, s0, s1, s2 FROM layers),
box AS (SELECT g.map_id, g.r, g.d, any_value(g.s0) AS s0, any_value(g.s1) AS s1, any_value(g.s2) AS s2, any_value(g.f0) AS f0, max(h.f0) AS top9
  FROM q g JOIN q h ON g.map_id = h.map_id AND abs(g.r - h.r) <= 1 AND abs(g.d - h.d) <= 1 GROUP BY 1, 2, 3),
tops AS (SELECT map_id, max(s0) AS fine, max(s2) AS coarse, max(r) AS rr, max(d) AS dd FROM q GROUP BY 1),
cand AS (SELECT b.map_id, b.r, b.d, round((s0 + s1 + s2) / 3, 9) AS score FROM box b JOIN tops USING (map_id)
  WHERE b.r BETWEEN 1 AND rr - 1 AND b.d BETWEEN 1 AND dd - 1 AND s0 >= 0.35 * (fine + 1e-6) AND f0 >= top9 AND s2 >= 0.2 * coarse),
peaks AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY map_id ORDER BY score DESC, r, d) AS INT) AS rank FROM cand) WHERE rank <= 8)"""


@check("grid_stable_peaks", f"WITH {_PEAKS} SELECT map_id, r, d, rank, round(score, 6) AS score FROM peaks")
def _(t):
    return grids.stable_peaks(t.grid_cells).select("map_id", "r", "d", "rank", r6("score"))


@check("agg_grid_features", f"""
WITH RECURSIVE {_PEAKS},
near AS (SELECT a.map_id, a.rank AS i, b.rank AS j FROM peaks a JOIN peaks b ON a.map_id = b.map_id AND (a.r - b.r) * (a.r - b.r) + (a.d - b.d) * (a.d - b.d) <= 9),
reach AS (SELECT map_id, i, j FROM near UNION SELECT r.map_id, r.i, n.j FROM reach r JOIN near n ON r.map_id = n.map_id AND r.j = n.i),
heads AS (SELECT map_id, count(DISTINCT low) AS clusters FROM (SELECT map_id, i, min(j) AS low FROM reach GROUP BY 1, 2) GROUP BY 1),
prof AS (SELECT map_id, r, avg(mag) AS p FROM grid_cells GROUP BY 1, 2),
pf AS (SELECT map_id, max(p) AS profile_max, arg_max(r, p) / count(*) AS profile_argmax FROM prof GROUP BY 1),
st AS (SELECT map_id, avg(mag) AS mean, max(mag) AS max, max(r) + 1 AS nr, max(d) + 1 AS nd FROM grid_cells GROUP BY 1),
pk AS (SELECT map_id, count(*) AS n_peaks, max(score) AS peak_max, avg(r) AS pr, avg(d) AS pd FROM peaks GROUP BY 1)
SELECT st.map_id, round(profile_max, 6) AS profile_max, round(profile_argmax, 6) AS profile_argmax, round(mean, 6) AS mean, round(max, 6) AS max,
  coalesce(n_peaks, 0) AS n_peaks, round(coalesce(peak_max, 0), 6) AS peak_max, round(coalesce(pr / nr, 0), 6) AS peak_r, round(coalesce(pd / nd, 0), 6) AS peak_d,
  coalesce(clusters, 0) AS clusters FROM st JOIN pf USING (map_id) LEFT JOIN pk USING (map_id) LEFT JOIN heads USING (map_id)
""")
def _(t):
    out = grids.grid_features(t.grid_cells, grids.stable_peaks(t.grid_cells))
    return out.select("map_id", "n_peaks", "clusters", *[r6(c) for c in ("profile_max", "profile_argmax", "mean", "max", "peak_max", "peak_r", "peak_d")])


@check("light_or_full", """
SELECT map_id, round(avg(mag) + max(mag) * 0.05, 6) AS energy, CASE WHEN map_id % 4 = 0 OR avg(mag) + max(mag) * 0.05 >= 5.45 THEN 'full' ELSE 'light' END AS path FROM grid_cells GROUP BY 1
""")
def _(t):
    flags = t.grid_cells.select("map_id").distinct().withColumn("triggered", F.col("map_id") % 4 == 0)
    return grids.light_or_full(t.grid_cells, flags, 5.45).select("map_id", r6("energy"), "path")


@check("agg_histogram", """
WITH p AS (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings),
c AS (SELECT vec_id % 20 AS crop, CAST(floor((x + 1) * 128) AS INT) AS ch FROM p),
b AS (SELECT crop, CAST(floor(ch / 16) AS INT) AS bin, count(*) AS n FROM c WHERE ch >= 0 AND ch < 256 GROUP BY 1, 2)
SELECT crop, 'ch' AS channel, bin, round(n / (sum(n) OVER (PARTITION BY crop) + 1e-6), 6) AS share FROM b
""")
def _(t):
    pixels = t.embeddings.select((F.col("vec_id") % 20).alias("crop"), F.explode("embedding").alias("x")).select(
        "crop", F.floor((F.col("x") + F.lit(1).cast("float")) * F.lit(128).cast("float")).cast("int").alias("ch")
    )
    return grids.channel_histogram(pixels, ["crop"], ["ch"]).select("crop", "channel", "bin", r6("share"))


@check("agg_angle_histogram", """
WITH p AS (SELECT class_id, x1 - 20 AS gx, y1 - 15 AS gy FROM det),
a AS (SELECT class_id, sqrt(gx * gx + gy * gy) AS m, CASE WHEN atan2(gy, gx) < 0 THEN degrees(atan2(gy, gx)) + 360 ELSE degrees(atan2(gy, gx)) END AS deg FROM p),
b AS (SELECT class_id, CAST(least(floor(deg / 45), 7) AS INT) AS bin, sum(m) AS m FROM a GROUP BY 1, 2)
SELECT class_id, bin, round(m / (sum(m) OVER (PARTITION BY class_id) + 1e-6), 6) AS share FROM b
""")
def _(t):
    pixels = t.det.select("class_id", (F.col("x1") - 20).alias("gx"), (F.col("y1") - 15).alias("gy"))
    return grids.angle_histogram(pixels, ["class_id"]).select("class_id", "bin", r6("share"))


@check("components", """
WITH RECURSIVE near AS (SELECT a.map_id, a.point_id AS i, b.point_id AS j FROM points a JOIN points b ON a.map_id = b.map_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 25),
reach AS (SELECT map_id, i, j FROM near UNION SELECT r.map_id, r.i, n.j FROM reach r JOIN near n ON r.map_id = n.map_id AND r.j = n.i)
SELECT map_id, i AS point_id, min(j) AS component FROM reach GROUP BY 1, 2
""")
def _(t):
    return components.components(t.points, ["map_id"], "point_id", 5.0).select("map_id", "point_id", "component")


@check("persistence", """
WITH o AS (SELECT map_id, i, v, row_number() OVER (PARTITION BY map_id ORDER BY v, i) AS k FROM
  (SELECT map_id, mag AS v, row_number() OVER (PARTITION BY map_id ORDER BY r, d) AS i FROM grid_cells)),
l AS (SELECT a.map_id, a.i, a.v, a.k, max(b.i) FILTER (b.i < a.i) AS lj, min(b.i) FILTER (b.i > a.i) AS rj
  FROM o a LEFT JOIN o b ON a.map_id = b.map_id AND b.k < a.k GROUP BY ALL),
w AS (SELECT l.*, max(c.k) FILTER (c.i > lj AND c.i < l.i) AS lk, max(c.k) FILTER (c.i > l.i AND c.i < rj) AS rk FROM l JOIN o c USING (map_id) GROUP BY ALL),
top AS (SELECT map_id, max(v) AS top FROM o GROUP BY 1),
p AS (SELECT w.map_id, w.k, w.v AS birth, 1 AS kind, least(lk, rk) AS ev, coalesce(o.v, top) AS death
  FROM w LEFT JOIN o ON o.map_id = w.map_id AND o.k = least(lk, rk) JOIN top ON top.map_id = w.map_id
  WHERE coalesce(lj <> w.i - 1, true) AND coalesce(rj <> w.i + 1, true)
  UNION ALL SELECT map_id, k, v, 0, k, v FROM w WHERE NOT (coalesce(lj <> i - 1, true) AND coalesce(rj <> i + 1, true)))
SELECT map_id, CAST(n - 1 AS INT) AS pos, round(birth, 6) AS birth, round(death, 6) AS death FROM
  (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY birth - death, ev NULLS LAST, kind, k) AS n FROM p) WHERE n <= 8
""")
def _(t):
    lines = t.grid_cells.groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("r", "d", "mag"))).alias("_l"))
    pairs = lines.select("map_id", F.posexplode(components.persistence(F.col("_l.mag"))).alias("pos", "p"))
    return pairs.select("map_id", "pos", r6("p.birth", "birth"), r6("p.death", "death"))
