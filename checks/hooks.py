"""A caller's own functions over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import check, rounded
from gridlark.operators import hooks


def _scorer():
    """An arithmetic scorer that refuses some of its rows."""

    def score(given):
        value, kind = given["value"].to_numpy(), given["event_type"].to_pylist()
        if (value > 200).any():
            raise OverflowError("value above 200")
        return {"score": value * 2 + 1, "label": [f"{k}-{int(v) // 50}" for k, v in zip(kind, value)]}

    return score


@check("score_rows", """
SELECT event_id, CASE WHEN value <= 200 THEN value * 2 + 1 END AS score, CASE WHEN value <= 200 THEN event_type || '-' || CAST(CAST(floor(value) AS BIGINT) // 50 AS VARCHAR) END AS label,
  CASE WHEN value > 200 THEN 'OverflowError: value above 200' END AS error FROM events
""")
def _(t):
    scored = hooks.score_rows(t.events, _scorer, ["value", "event_type"], "score double, label string")
    return scored.select("event_id", "score", "label", "error")


def _embedder():
    """Every other component, for rows that it can do; nothing for some, an error for others."""

    def embed(given):
        ids, vectors = given["vec_id"].to_numpy(), given["embedding"].to_pylist()
        if (ids % 7 == 3).any():
            raise RuntimeError("no embedding")
        return {"vector": [None if i % 11 == 5 else np.asarray(v, float)[::2] for i, v in zip(ids, vectors)]}

    return embed


@check("embed_fallback", """
WITH v AS (SELECT vec_id, embedding, vec_id % 7 = 3 AS bad, vec_id % 7 <> 3 AND vec_id % 11 <> 5 AS own FROM embeddings),
p AS (SELECT *, list_transform(embedding, lambda x: greatest(0, least(15, CAST(floor((CAST(x AS DOUBLE) + 1) / 0.125) AS INT)))) AS places FROM v),
f AS (SELECT *, CASE WHEN own THEN list_transform(range(0, 32), lambda i: CAST(embedding[2 * i + 1] AS DOUBLE))
  ELSE list_transform(range(0, 16), lambda i: len(list_filter(places, lambda x: x = i)) / CAST(len(places) AS DOUBLE)) END AS w FROM p)
SELECT vec_id, own AS embedded, CASE WHEN bad THEN 'RuntimeError: no embedding' END AS embed_error, CAST(len(w) AS INT) + CASE WHEN own THEN 0 ELSE 16 END AS n,
  round(list_sum(list_transform(range(0, len(w)), lambda i: w[i + 1] * (i + 1))), 6) AS mix FROM f
""")
def _(t):
    fallback = hooks.histogram_features(F.col("embedding"), 16, -1.0, 1.0)
    out = hooks.embed_rows(t.embeddings, _embedder, ["vec_id", "embedding"], fallback, 32)
    mix = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("vec_id", "embedded", "embed_error", F.size("vector").alias("n"), rounded(mix, 6).alias("mix"))
