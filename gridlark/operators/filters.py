"""Constant-velocity filtering of known tracks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.vectors import let
from gridlark.operators.ordered import running
from gridlark.session import cut_lineage

_FIELDS = ("x", "y", "vx", "vy", "p00", "p01", "p11", "w", "h")
_OUT = "array<struct<o:{0}," + ",".join(f"{f}:double" for f in _FIELDS) + ">>"


def _state(**cols: Column) -> Column:
    return F.struct(*[cols[f].alias(f) for f in _FIELDS])


def _advance(s: Column, r: Column, q: float) -> Column:
    """One row: move the state by dt, then take the measurement in if there is one.

    Both axes share one covariance and never mix, so three numbers describe it.
    """
    dt = r["dt"]
    moved = _state(
        x=s["x"] + s["vx"] * dt, y=s["y"] + s["vy"] * dt, vx=s["vx"], vy=s["vy"],
        p00=s["p00"] + 2 * dt * s["p01"] + dt * dt * s["p11"] + q * dt * dt,
        p01=s["p01"] + dt * s["p11"] + q * dt, p11=s["p11"] + q, w=s["w"], h=s["h"],
    )

    def take(m: Column) -> Column:
        gains = F.struct(
            (m["p00"] / (m["p00"] + r["noise"])).alias("k0"), (m["p01"] / (m["p00"] + r["noise"])).alias("k1"),
            (r["zx"] - m["x"]).alias("dx"), (r["zy"] - m["y"]).alias("dy"),
        )
        size = lambda old, new: F.when(new.isNull(), old).otherwise(0.8 * old + 0.2 * F.greatest(F.lit(4.0), new))
        updated = let(
            gains,
            lambda g: _state(
                x=m["x"] + g["k0"] * g["dx"], y=m["y"] + g["k0"] * g["dy"],
                vx=m["vx"] + g["k1"] * g["dx"], vy=m["vy"] + g["k1"] * g["dy"],
                p00=m["p00"] * (1 - g["k0"]), p01=m["p01"] * (1 - g["k0"]), p11=m["p11"] - g["k1"] * m["p01"],
                w=size(m["w"], r["zw"]), h=size(m["h"], r["zh"]),
            ),
        )
        return F.when(r["zx"].isNull(), m).otherwise(updated)

    return let(moved, take)


def _first(r: Column, meas_var: float, p11: float = 100.0) -> Column:
    zero = F.lit(0.0)
    return _state(
        x=F.coalesce(r["zx"], zero), y=F.coalesce(r["zy"], zero), vx=zero, vy=zero, p00=F.lit(float(meas_var)), p01=zero, p11=F.lit(p11),
        w=F.greatest(F.lit(4.0), r["zw"]), h=F.greatest(F.lit(4.0), r["zh"]),
    )


def _fold(rows: Column, start: Column, q: float, kind: str) -> Column:
    """States after each row of `rows`, from `start`."""
    zero = F.struct(start.alias("s"), F.array().cast(_OUT.format(kind)).alias("out"))

    def step(a, r):
        return let(
            _advance(a["s"], r, q),
            lambda n: F.struct(
                n.alias("s"),
                F.concat(a["out"], F.array(F.struct(r["o"].alias("o"), *[n[f].alias(f) for f in _FIELDS]))).alias("out"),
            ),
        )

    return F.aggregate(rows, zero, step)


#: What a run of filter steps does to any state, as matrices in row order: A and C (the
#: covariance it adds), J and the two axes' e (what its measurements say about the state
#: before it), the two axes' b, and the linear maps of the two sizes.
_RUN = (
    "a00", "a01", "a10", "a11", "c00", "c01", "c11", "j00", "j01", "j11", "ex0", "ex1", "ey0", "ey1", "bx0", "bx1", "by0", "by1", "ws", "wc", "hs", "hc"
)
_STATE = ("x", "vx", "y", "vy", "p00", "p01", "p11", "w", "h")


def _mul(*factors):
    """Product of 2 x 2 matrices, each four arrays in row order."""
    (a, b, c, d), *rest = factors
    for e, f, g, h in rest:
        a, b, c, d = a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h
    return a, b, c, d


def _through(c, j, side: bool):
    """Inverse of ``I + C J``, or of ``I + J C`` on the other side."""
    p, q, r, s = _mul(j, c) if side else _mul(c, j)
    p, s = 1 + p, 1 + s
    det = p * s - q * r
    return s / det, -q / det, -r / det, p / det


def _apply(m, v):
    return m[0] * v[0] + m[1] * v[1], m[2] * v[0] + m[3] * v[1]


def _compose(i: dict, j: dict) -> dict:
    """Run `i`, then run `j`; arrays of runs at once."""
    full = lambda r, n: (r[n + "00"], r[n + "01"], r[n + "01"], r[n + "11"])
    square = lambda r: (r["a00"], r["a01"], r["a10"], r["a11"])
    turned = lambda m: (m[0], m[2], m[1], m[3])
    ai, aj, ci, cj, ji, jj = square(i), square(j), full(i, "c"), full(j, "c"), full(i, "j"), full(j, "j")
    ahead = _mul(aj, _through(ci, jj, False))
    back = _mul(turned(ai), _through(ci, jj, True))
    a, c, k = _mul(ahead, ai), _mul(ahead, ci, turned(aj)), _mul(back, jj, ai)
    out = dict(zip(("a00", "a01", "a10", "a11"), a))
    out |= {"c00": c[0] + cj[0], "c01": c[1] + cj[1], "c11": c[3] + cj[3], "j00": k[0] + ji[0], "j01": k[1] + ji[1], "j11": k[3] + ji[3]}
    for axis in "xy":
        bi, bj, ei, ej = ((r[n + axis + "0"], r[n + axis + "1"]) for n in "be" for r in (i, j))
        u, v = _apply(ci, ej), _apply(jj, bi)
        b, e = _apply(ahead, (bi[0] + u[0], bi[1] + u[1])), _apply(back, (ej[0] - v[0], ej[1] - v[1]))
        out |= {f"b{axis}0": b[0] + bj[0], f"b{axis}1": b[1] + bj[1], f"e{axis}0": e[0] + ei[0], f"e{axis}1": e[1] + ei[1]}
    for n in "wh":
        out |= {n + "s": i[n + "s"] * j[n + "s"], n + "c": i[n + "c"] * j[n + "s"] + j[n + "c"]}
    return out


def _all(run: dict) -> dict:
    """All runs of the arrays as one, halving their number again and again."""
    n = len(run["a00"])
    while n > 1:
        even = n - n % 2
        done = _compose({k: v[0:even:2] for k, v in run.items()}, {k: v[1:even:2] for k, v in run.items()})
        run = {k: np.concatenate([done[k], run[k][even:]]) for k in run}
        n = len(run["a00"])
    return run


def _steps(rows: pd.DataFrame, q: float) -> dict:
    """Every row as a run of one step: move by dt, then take a measurement in if there is one."""
    dt, noise, zx, zy = (rows[c].to_numpy(float) for c in ("dt", "noise", "zx", "zy"))
    seen = ~np.isnan(zx)
    q00, q01, q11 = q * dt * dt, q * dt, np.full(len(dt), float(q))
    weight = np.where(seen, 1 / (q00 + noise), 0.0)
    k0, k1 = q00 * weight, q01 * weight
    x, y = np.where(seen, zx, 0.0), np.where(seen, zy, 0.0)
    run = {"a00": 1 - k0, "a01": (1 - k0) * dt, "a10": -k1, "a11": 1 - k1 * dt, "c00": (1 - k0) * q00, "c01": (1 - k0) * q01, "c11": q11 - k1 * q01}
    run |= {"j00": weight, "j01": weight * dt, "j11": weight * dt * dt}
    for axis, z in (("x", x), ("y", y)):
        run |= {f"e{axis}0": z * weight, f"e{axis}1": z * weight * dt, f"b{axis}0": k0 * z, f"b{axis}1": k1 * z}
    for n in "wh":
        new = rows["z" + n].to_numpy(float)
        some = seen & ~np.isnan(new)
        run |= {n + "s": np.where(some, 0.8, 1.0), n + "c": np.where(some, 0.2 * np.maximum(4.0, new), 0.0)}
    return run


def _after(state: dict, run: dict) -> dict:
    """The state at the end of a run that starts from `state`."""
    p = (state["p00"], state["p01"], state["p01"], state["p11"])
    a = (run["a00"], run["a01"], run["a10"], run["a11"])
    ahead = _mul(a, _through(p, (run["j00"], run["j01"], run["j01"], run["j11"]), False))
    c = _mul(ahead, p, (a[0], a[2], a[1], a[3]))
    out = {"p00": c[0] + run["c00"], "p01": c[1] + run["c01"], "p11": c[3] + run["c11"]}
    for axis in "xy":
        u = _apply(p, (run[f"e{axis}0"], run[f"e{axis}1"]))
        m = _apply(ahead, (state[axis] + u[0], state["v" + axis] + u[1]))
        out |= {axis: m[0] + run[f"b{axis}0"], "v" + axis: m[1] + run[f"b{axis}1"]}
    return out | {n: run[n + "s"] * state[n] + run[n + "c"] for n in "wh"}


def _block_starts(runs: DataFrame, first: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """The state before every run `_b`, given the state `first` before each key's first.

    Runs of `fan` neighbours compose to one of the level above, up to a level with few.
    """
    types = dict(runs.dtypes)
    ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    grouped = runs.withColumn("_g", F.floor(F.col("_b") / fan).cast("bigint"))

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        one = _all({c: pdf[c].to_numpy(float) for c in _RUN})
        return pd.DataFrame({**{k: pdf[k].iloc[:1].to_numpy() for k in keys}, "_b": pdf["_g"].iloc[:1].to_numpy(), **one})

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        state = {c: float(pdf["_s_" + c].iloc[0]) for c in _STATE}
        out = []
        for row in pdf[list(_RUN)].to_numpy(float):
            out.append([state[c] for c in _STATE])
            state = _after(state, dict(zip(_RUN, row)))
        return pd.DataFrame(out, columns=list(_STATE)).assign(**{k: pdf[k].to_numpy() for k in (*keys, "_b")})[[*keys, "_b", *_STATE]]

    if (runs.agg(F.max("_b")).first()[0] or 0) < fan:
        starts, on = first, keys
    else:
        above = grouped.groupBy(*keys, "_g").applyInPandas(up, f"{ddl}, _b bigint, " + ", ".join(f"{c} double" for c in _RUN))
        starts, on = _block_starts(above, first, keys, fan).withColumnRenamed("_b", "_g"), [*keys, "_g"]
    named = starts.select(*on, *[F.col(c).alias("_s_" + c) for c in _STATE])
    walked = grouped.join(named, on).groupBy(*keys, "_g").applyInPandas(down, f"{ddl}, _b bigint, " + ", ".join(f"{c} double" for c in _STATE))
    return walked


def track_filter(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    dt: Column,
    noise: Column | float = 4.0,
    q: float = 25.0,
    meas_var: float = 4.0,
    zx: str = "zx",
    zy: str = "zy",
    zw: str | None = None,
    zh: str | None = None,
    block: int = 512,
    fan: int = 512,
    **options,
) -> DataFrame:
    """Filtered state after each row of each known track.

    `dt` is the time since the previous row of the track; a row without a measurement
    only moves the state. `noise` may vary per row, which is how a second sensor's rows
    are taken in. The first row must hold a measurement.

    Tracks are cut into blocks of `block` rows. What a block does to any state it may
    start from composes with the next block's doing (covariances by their fractional
    linear map, means by linear maps), level by level, so the state before every block is
    known without walking the track, however little the filter forgets. Then each block
    is walked on its own.
    """
    keys = list(keys)
    noise_col = noise if isinstance(noise, Column) else F.lit(float(noise))
    opt = lambda c: F.lit(None).cast("double") if c is None else F.col(c).cast("double")
    kind = dict(rows.dtypes)[order]
    placed = running(rows, keys, [order], {"_pos": ("sum", F.lit(1).cast("bigint"), True)}, **options)
    parts = {
        "dt": F.coalesce(dt, F.lit(0.0)).cast("double"), "noise": noise_col.cast("double"),
        "zx": F.col(zx).cast("double"), "zy": F.col(zy).cast("double"), "zw": opt(zw), "zh": opt(zh),
    }
    slim = placed.select(*keys, "_pos", F.col(order).alias("o"), *[v.alias(n) for n, v in parts.items()])
    slim = slim.withColumn("_b", F.floor((F.col("_pos") - 1) / block).cast("bigint"))
    entry = F.struct("_pos", "o", *parts)
    long = slim.where(F.col("_pos") > block).limit(1).count() > 0
    if not long:  # whole tracks, whatever their length is by the time the plan runs
        slim = slim.withColumn("_b", F.lit(0).cast("bigint"))
    lists = slim.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(entry)).alias("_rows"))

    def emit(df: DataFrame, start: Column | None) -> DataFrame:
        head, rest = F.get("_rows", F.lit(0)), F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0)))
        first = _first(head, meas_var)
        own = F.array(F.struct(head["o"].alias("o"), *[first[f].alias(f) for f in _FIELDS])).cast(_OUT.format(kind))
        out = F.concat(own, _fold(rest, first, q, kind)["out"])
        if start is not None:
            out = F.when(F.col("_b") == 0, out).otherwise(_fold(F.col("_rows"), start, q, kind)["out"])
        return df.select(*keys, F.explode(out).alias("_o")).select(*keys, F.col("_o.o").alias(order), *[f"_o.{f}" for f in _FIELDS])

    if not long:
        return emit(lists, None)
    ddl = ", ".join(f"{k} {dict(slim.dtypes)[k]}" for k in keys)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        lead = {k: pdf[k].iloc[:1].to_numpy() for k in (*keys, "_b")}
        if pdf["_pos"].iloc[0] == 1:
            pdf = pdf.iloc[1:]  # the first row is where the state starts
        still = pd.DataFrame({"dt": [0.0], "noise": [1.0], **{c: [np.nan] for c in ("zx", "zy", "zw", "zh")}})
        one = _all(_steps(pdf, q)) if len(pdf) else _steps(still, 0.0)
        return pd.DataFrame({**lead, **one})

    runs = slim.groupBy(*keys, "_b").applyInPandas(summarise, f"{ddl}, _b bigint, " + ", ".join(f"{c} double" for c in _RUN))
    begin = _first(F.struct(*parts), meas_var)
    first = slim.where("_pos = 1").select(*keys, begin.alias("s")).select(*keys, *[F.coalesce(F.col(f"s.{c}"), F.lit(4.0) if c in "wh" else F.lit(0.0)).alias(c) for c in _STATE])
    starts = _block_starts(cut_lineage(runs), first, keys, fan)
    joined = lists.join(starts, [*keys, "_b"])
    return emit(joined, _state(**{f: F.col(f) for f in _FIELDS}))
