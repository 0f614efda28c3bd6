"""Compare a Spark result with the SQL twin's result, value by value."""

from __future__ import annotations

import math

import duckdb

from checks.views import BASE


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


SAME = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "FLOAT": "float", "TINYINT": "tinyint", "SMALLINT": "smallint",
}


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    spark_types = dict(df.dtypes)
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for c in cols:
        if SAME.get(duck_types[c]) != spark_types[c]:
            return f"type of {c}: {spark_types[c]} vs {duck_types[c]}"
    mine = sorted(tuple(_key(r[c]) for c in cols) for r in df.collect())
    order = [rel.columns.index(c) for c in cols]
    theirs = sorted(tuple(_key(r[i]) for i in order) for r in rel.fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, columns {cols}: {bad[0][0]} vs {bad[0][1]}"
    return None
