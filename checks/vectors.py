"""Vector expressions, prototypes and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, rounded
from gridlark.functions import vectors as V
from gridlark.operators import prototypes as P

DIM = 48


def _flat(df, keys, column):
    return df.select(*keys, F.posexplode(column).alias("pos", "v"))


def _codes(t):
    encode = V.encoder(64, DIM, V.pattern_projection)
    return t.embeddings.select("vec_id", "label", encode("embedding").alias("code"))


_UNNEST = "SELECT vec_id, label, unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding) AS x FROM embeddings"
_CODES = f"""e AS ({_UNNEST}), n AS (SELECT vec_id, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS norm FROM e GROUP BY 1),
pr AS (SELECT e.vec_id, e.label, r.r::INT AS pos, sum(e.x::DOUBLE / n.norm * CASE WHEN (r.r * 31 + e.pos * 17 + r.r * e.pos) % 7 < 4 THEN 0.125 ELSE -0.125 END) AS s
  FROM e JOIN n USING (vec_id), range({DIM}) r(r) GROUP BY 1, 2, 3),
codes AS (SELECT vec_id, label, pos, CAST(CASE WHEN s < 0 THEN -1 ELSE 1 END AS INT) AS v FROM pr)"""


@check("vec_bipolar", f"SELECT vec_id, pos, CAST(CASE WHEN x < 0 THEN -1 ELSE 1 END AS INT) AS v FROM ({_UNNEST})")
def _(t):
    return _flat(t.embeddings.select("vec_id", V.bipolar(F.col("embedding")).alias("b")), ["vec_id"], "b")


@check("vec_normalise", f"""
WITH e AS ({_UNNEST}), g AS (SELECT vec_id, r.pos::INT AS pos, CASE WHEN r.pos < 64 THEN (SELECT 0) END AS z FROM embeddings, range(80) r(pos)),
n AS (SELECT vec_id, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS norm FROM e GROUP BY 1)
SELECT g.vec_id, g.pos, round(coalesce(e.x::DOUBLE / n.norm, 0), 9) AS v FROM g JOIN n USING (vec_id) LEFT JOIN e ON g.vec_id = e.vec_id AND g.pos = e.pos
""")
def _(t):
    rows = _flat(t.embeddings.select("vec_id", V.normalise(F.col("embedding"), 80).alias("u")), ["vec_id"], "u")
    return rows.withColumn("v", rounded("v", 9))


@check("vec_bind", f"""
WITH e AS ({_UNNEST}) SELECT vec_id, pos, CAST(CASE WHEN x < 0 THEN -1 ELSE 1 END * CASE WHEN (pos * 13 + 5) % 11 < 5 THEN -1 ELSE 1 END AS INT) AS v FROM e
""")
def _(t):
    bound = V.bind(V.bipolar(F.col("embedding")), V.role_pattern(64))
    return _flat(t.embeddings.select("vec_id", bound.alias("b")), ["vec_id"], "b")


@check("vec_cosine", """
WITH p AS (SELECT a.vec_id, a.embedding AS u, b.embedding AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
x AS (SELECT vec_id, unnest(u)::DOUBLE AS a, unnest(v)::DOUBLE AS b FROM p)
SELECT vec_id, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-8), 9) AS cosine FROM x GROUP BY 1
""")
def _(t):
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = t.embeddings.select("vec_id", "embedding").join(nxt, "vec_id")
    return pairs.select("vec_id", rounded(V.cosine(F.col("embedding"), F.col("other")), 9).alias("cosine"))


@check("vec_encode", f"WITH {_CODES} SELECT vec_id, pos, v FROM codes")
def _(t):
    return _flat(_codes(t), ["vec_id"], "code")


_GAUSS = ", ".join(f"{w:.17e}" for w in V.gaussian_projection(64, DIM).ravel())


@check("vec_encode_gaussian", f"""
WITH e AS ({_UNNEST}), n AS (SELECT vec_id, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS norm FROM e GROUP BY 1),
g AS (SELECT (i // 64)::INT AS r, (i % 64)::INT AS pos, w FROM (SELECT unnest([{_GAUSS}]) AS w, unnest(range({DIM} * 64)) AS i))
SELECT e.vec_id, g.r AS pos, CAST(CASE WHEN sum(e.x::DOUBLE / n.norm * g.w) < -1e-12::DOUBLE THEN -1 ELSE 1 END AS INT) AS v FROM e JOIN n USING (vec_id) JOIN g ON g.pos = e.pos GROUP BY 1, 2
""")
def _(t):
    return _flat(t.embeddings.select("vec_id", V.encoder(64, DIM)("embedding").alias("code")), ["vec_id"], "code")


@check("vec_bind_aux", f"""
WITH {_CODES}, a AS (SELECT vec_id, r.pos::INT AS pos, ((vec_id * 7 + r.pos * 5) % 9 - 4)::DOUBLE AS x FROM embeddings, range(8) r(pos) WHERE vec_id % 3 > 0),
an AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM a GROUP BY 1),
ap AS (SELECT a.vec_id, r.r::INT AS pos, sum(CASE WHEN an.norm > 0 THEN a.x / an.norm ELSE a.x END * CASE WHEN (r.r * 31 + a.pos * 17 + r.r * a.pos) % 7 < 4 THEN 0.125 ELSE -0.125 END) AS s
  FROM a JOIN an USING (vec_id), range({DIM}) r(r) GROUP BY 1, 2),
m AS (SELECT vec_id, pos, CASE WHEN round(s, 12) < 0 THEN -1 ELSE 1 END * CASE WHEN (pos * 13 + 5) % 11 < 5 THEN -1 ELSE 1 END AS v FROM ap)
SELECT c.vec_id, c.pos, CAST(CASE WHEN c.vec_id % 3 > 0 THEN c.v * m.v ELSE c.v END AS INT) AS v FROM codes c LEFT JOIN m ON c.vec_id = m.vec_id AND c.pos = m.pos
""")
def _(t):
    k = F.col("vec_id")
    aux = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((k * 7 + i * 5) % 9 - 4).cast("double"))
    aux = F.when(k % 3 == 1, aux).when(k % 3 == 2, aux).when(k % 6 == 0, F.array().cast("array<double>"))
    encode = V.encoder(64, DIM, V.pattern_projection)
    bound = V.bind_aux(F.col("code"), F.col("aux_code"), F.col("aux"), DIM)
    coded = _codes(t).withColumn("aux", aux).withColumn("aux_code", encode("aux"))
    rows = coded.select("vec_id", bound.alias("b"))
    return _flat(rows, ["vec_id"], "b")


@check("agg_prototype", f"WITH {_CODES} SELECT label, pos, CAST(CASE WHEN sum(v) < 0 THEN -1 ELSE 1 END AS INT) AS v FROM codes GROUP BY 1, 2")
def _(t):
    return _flat(P.bundle(_codes(t), "label", "code"), ["label"], "prototype")


@check("agg_prototype_add", f"""
WITH {_CODES} SELECT label, pos, CAST(list_reduce(list(v ORDER BY vec_id), lambda a, b: CASE WHEN a + b < 0 THEN -1 ELSE 1 END) AS INT) AS v FROM codes GROUP BY 1, 2
""")
def _(t):
    return _flat(P.bundle_one_by_one(_codes(t), "label", "code"), ["label"], "prototype")


_MATCH = f"""{_CODES}, protos AS (SELECT label, pos, CASE WHEN sum(v) < 0 THEN -1 ELSE 1 END AS p FROM codes GROUP BY 1, 2),
sc AS (SELECT c.vec_id, p.label, sum(c.v * p.p) / ({DIM} + 1e-8) AS score FROM codes c JOIN protos p ON c.pos = p.pos GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS n FROM sc)"""


@check("topk_match", f"""
WITH {_MATCH} SELECT vec_id, CAST(max(CASE WHEN n = 1 AND score >= 0.4 THEN label END) AS INT) AS match, round(max(CASE WHEN n = 1 THEN score END), 6) AS score,
  round(max(CASE WHEN n = 1 THEN score END) - max(CASE WHEN n = 2 THEN score END), 6) AS margin FROM rk GROUP BY vec_id
""")
def _(t):
    codes = _codes(t)
    out = P.match(codes, P.bundle(codes, "label", "code"), ["vec_id"], "code", min_cosine=0.4)
    return out.select("vec_id", "match", rounded("score", 6).alias("score"), rounded("margin", 6).alias("margin"))


@check("win_margin", """
WITH s AS (SELECT frame_id, class_id, conf AS score FROM det), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC) AS n FROM s)
SELECT frame_id, max(score) AS best, max(score) - coalesce(max(CASE WHEN n = 2 THEN score END), 0) AS margin FROM r GROUP BY 1
""")
def _(t):
    return P.margins(t.det, ["frame_id"], "conf")
