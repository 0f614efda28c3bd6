"""Matching tracks with detections or points inside a frame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.functions import vectors as V
from gridlark.operators.ordered import HOT_ROWS, islands, largest_group
from gridlark.operators.overlap import overlap_pairs
from gridlark.operators.runs import turns, whole_keys
from gridlark.session import stored_table

#: Frames with at most this many pairs are matched whole.
WHOLE_PAIRS = 100_000


def squared_distance(dx: Column, dy: Column, p00: Column, noise: float) -> Column:
    """Distance of a point from a predicted centre under equal axis variances."""
    return (dx * dx + dy * dy) / (p00 + F.lit(noise))


def coast_gate(tsu: Column, gate: float = 9.21, slope: float = 0.35, ceiling: float = 3.0) -> Column:
    return F.lit(gate) * F.least(F.lit(ceiling), 1.0 + slope * tsu)


def axis_islands(
    df: DataFrame, keys: Sequence[str], tags: Sequence[str], size: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Split rows with extents ``_xlo.._yhi`` into groups that cannot touch each other."""
    if size is None or size > hot_rows:
        size = largest_group(df, keys)
    ix = islands(df, keys, "_xlo", "_xhi", ["_xhi", *tags], "_ix", hot_rows, size)
    return islands(ix, [*keys, "_ix"], "_ylo", "_yhi", ["_yhi", *tags], "_iy", hot_rows, size)


def _pair_bound(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> int:
    """Most pairs one group can give, from the two narrow key counts."""
    return largest_group(left.select(*keys), keys) * largest_group(right.select(*keys), keys)


def nearest_greedy(
    tracks: DataFrame, points: DataFrame, keys: Sequence[str], track: str, point: str, radius: float = 120.0
) -> DataFrame:
    """Each track, in order, takes the nearest point within `radius` that no earlier track took.

    Rows too far apart to influence each other are separated first, so each fold sees
    one cluster. Candidate pairs meet on square cells of side `radius`.
    """
    keys = list(keys)
    cx, cy = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    lhs = tracks.select(*keys, track, "x", "y", cx.alias("_cx"), cy.alias("_cy"))
    rhs = points.select(*keys, point, F.col("x").alias("_px"), F.col("y").alias("_py"))
    rhs = rhs.withColumn("_cx", F.explode(F.transform(around, lambda o: F.floor(F.col("_px") / radius) + o)))
    rhs = rhs.withColumn("_cy", F.explode(F.transform(around, lambda o: F.floor(F.col("_py") / radius) + o)))
    d2 = (F.col("x") - F.col("_px")) * (F.col("x") - F.col("_px")) + (F.col("y") - F.col("_py")) * (F.col("y") - F.col("_py"))
    pairs = lhs.join(rhs, [*keys, "_cx", "_cy"]).withColumn("d2", d2).where(F.col("d2") < radius * radius)
    # a track's reach is one disc, so pairs of different clusters never share a point
    reach = pairs.withColumns(
        {"_xlo": F.col("x") - radius, "_xhi": F.col("x") + radius, "_ylo": F.col("y") - radius, "_yhi": F.col("y") + radius}
    )
    split = axis_islands(reach, keys, [track, point], _pair_bound(tracks, points, keys))
    rows = F.array_sort(F.collect_list(F.struct(F.col(track).alias("t"), "d2", F.col(point).alias("p"))))
    state = "array<struct<t:{0},p:{1},d2:double>>".format(dict(tracks.dtypes)[track], dict(points.dtypes)[point])

    def take(done, r):
        taken = F.exists(done, lambda m: (m["t"] == r["t"]) | (m["p"] == r["p"]))
        entry = F.struct(r["t"].alias("t"), r["p"].alias("p"), r["d2"].alias("d2"))
        return F.when(taken, done).otherwise(F.concat(done, F.array(entry)))

    folded = split.groupBy(*keys, "_ix", "_iy").agg(rows.alias("_rows"))
    matches = folded.select(*keys, F.explode(F.aggregate("_rows", F.array().cast(state), take)).alias("m"))
    return matches.select(*keys, F.col("m.t").alias(track), F.col("m.p").alias(point), F.col("m.d2").alias("d2"))


def least_cost(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each column's partner (-1 for none) in a least-cost full matching, and the places others may use.

    Shortest augmenting paths with row and column prices; rows may not outnumber columns.
    """
    n, m = cost.shape
    price_r, price_c = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for r in range(n):
        dist = np.full(m, np.inf)
        via = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, col, base = r, -1, 0.0
        while True:
            reduced = base + cost[row] - price_r[row] - price_c
            better = ~done & (reduced < dist)
            dist[better] = reduced[better]
            via[better] = col
            open_dist = np.where(done, np.inf, dist)
            col = int(np.argmin(open_dist))
            base = dist[col]
            done[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        seen = done.copy()
        seen[col] = False
        price_r[r] += base
        for j in np.flatnonzero(seen):
            price_r[owner[j]] += base - dist[j]
            price_c[j] -= base - dist[j]
        while col >= 0:
            prev = via[col]
            owner[col] = owner[prev] if prev >= 0 else r
            col = prev
    # another matching of this cost uses nothing but pairs that its prices allow
    return owner, cost - price_r[:, None] - price_c <= 1e-8


def best_matching(pairs: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Most of the given (row, column) pairs first, then least total cost.

    Of equal totals (to nine digits) the one that does without the highest columns wins.
    """
    found, tight = _one_best(pairs)
    total = lambda some: round(sum(pairs[p] for p in some), 9)
    left = pairs
    for c in sorted({c for _, c in pairs}, reverse=True) if len(tight) > len(found) else ():
        less = {p: v for p, v in left.items() if p[1] != c}
        if any(j == c for _, j in found):
            # only a lower column that is free can stand in
            used = {j for _, j in found}
            if not any(j < c and j not in used for _, j in less):
                continue
            other, _ = _one_best(less)
            if len(other) < len(found) or total(other) > total(found):
                continue
            found = other
        left = less
    return found


def _one_best(pairs: dict[tuple[int, int], float]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """A best matching, and the pairs that it or any other one as good may use."""
    rows = sorted({r for r, _ in pairs})
    cols = sorted({c for _, c in pairs})
    full = np.full((len(rows), len(cols)), 1e4)
    at_r, at_c = {r: i for i, r in enumerate(rows)}, {c: i for i, c in enumerate(cols)}
    for (r, c), cost in pairs.items():
        full[at_r[r], at_c[c]] = cost
    if len(rows) <= len(cols):
        owner, tight = least_cost(full)
        found = [(rows[r], cols[c]) for c, r in enumerate(owner) if r >= 0]
    else:
        owner, tight = least_cost(full.T)
        tight = tight.T
        found = [(rows[r], cols[c]) for r, c in enumerate(owner) if c >= 0]
    return sorted(p for p in found if p in pairs), [p for p in pairs if tight[at_r[p[0]], at_c[p[1]]]]


def _apart(pairs: dict) -> list[dict]:
    """Groups of pairs that share a row or column."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r, c in pairs:
        up[top((0, r))] = top((1, c))
    groups: dict = {}
    for p, cost in pairs.items():
        groups.setdefault(top((0, p[0])), {})[p] = cost
    return list(groups.values())


def contested(pairs: dict) -> list[tuple[int, int]]:
    """Best matching, solved separately for groups of pairs that share a row or column."""
    return sorted(m for g in _apart(pairs) for m in (g if len(g) == 1 else _one_sided(g) or best_matching(g)))


def _one_sided(pairs: dict) -> list[tuple[int, int]]:
    """`best_matching` where all pairs share one row or one column; empty for others."""
    (r, c), *rest = pairs
    if all(i == r for i, _ in rest):
        return [min(pairs, key=lambda p: (round(pairs[p], 9), p[1]))]
    if all(j == c for _, j in rest):
        return [min(pairs, key=lambda p: (pairs[p], p[0]))]
    return []


def frame_matching(pairs: dict[tuple[int, int], float], most: int = 50_000) -> list[tuple[int, int]]:
    """Best matching of a whole frame, ties settled as a plain walk over its rows settles them.

    Totals are added up row by row over the frame, so they may tell matchings apart that
    are equal in the groups on their own. Of one set of columns the least total wins, to
    the last bit, then the lowest rows; of different sets the least total to nine digits,
    then the one that does without the highest columns. Only pairs that some best matching
    uses are walked. With more than `most` sets at a time the groups decide alone.
    """
    fixed: dict = {}
    loose: dict = {}
    skips: dict = {}
    for k, g in enumerate(_apart(pairs)):
        found, tight = (list(g), list(g)) if len(g) == 1 else _one_best(g)
        if len(tight) <= len(found):
            fixed.update(found)
            continue
        for r, c in tight:
            loose.setdefault(r, (k, []))[1].append(c)
        skips[k] = len({r for r, _ in tight}) - len(found)
    if not loose:
        return sorted(fixed.items())
    # sets of columns with their total, their pairs and how many rows each group may still pass over
    states = {0: (0.0, (), skips)}
    for r in sorted([*fixed, *loose]):
        if r in fixed:
            cost = pairs[r, fixed[r]]
            states = {m: (total + cost, *rest) for m, (total, *rest) in states.items()}
            continue
        k, cols = loose[r]
        after: dict = {}
        for m, (total, path, left) in states.items():
            steps = [(m | 1 << c, total + pairs[r, c], (*path, (r, c)), left) for c in cols if not m >> c & 1]
            if left[k]:
                steps.append((m, total, path, {**left, k: left[k] - 1}))
            for to, *state in steps:
                if to not in after or state[:2] < list(after[to][:2]):
                    after[to] = tuple(state)
        states = after
        if len(states) > most:
            return contested(pairs)
    _, _, path = min((np.floor(total * 1e9 + 0.5), m, path) for m, (total, path, _) in states.items())
    return sorted([*fixed.items(), *path])


def candidate_costs(
    tracks: DataFrame,
    det: DataFrame,
    keys: Sequence[str],
    track: str,
    number: str,
    noise: float = 4.0,
    gate: float = 9.21,
    w_iou: float = 0.55,
    w_space: float = 0.30,
    w_look: float = 0.30,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Valid track/detection pairs of each frame with their cost, all in JVM expressions.

    `tracks` has x, y, w, h, p00, tsu and optional name and vector; `det` has x1..y2 and
    optional name and vector; columns of `det` in `carry` stay. A pair can only be valid when the boxes overlap or the
    centres lie within the gate, so pairs meet on the grid cells of those extents.
    """
    keys = list(keys)
    reach = F.sqrt(coast_gate(F.col("tsu"), gate) * (F.col("p00") + noise))
    half_w, half_h = F.col("w") * 0.5, F.col("h") * 0.5
    optional = lambda df: [
        F.col(n) if n in df.columns else F.lit(None).cast(ty).alias(n) for n, ty in (("name", "string"), ("vector", "array<double>"))
    ]
    # extents grow by a hair so that touching counts as meeting
    t = tracks.select(
        *keys, F.col(track).alias("t_id"), "x", "y", "w", "h", "p00", "tsu", *optional(tracks),
        (F.col("x") - F.greatest(half_w, reach) - 1e-6).alias("x1"), (F.col("y") - F.greatest(half_h, reach) - 1e-6).alias("y1"),
        (F.col("x") + F.greatest(half_w, reach) + 1e-6).alias("x2"), (F.col("y") + F.greatest(half_h, reach) + 1e-6).alias("y2"),
    )
    d = det.select(
        *keys, F.col(number).alias("d_id"), *optional(det), *[F.col(c).alias(f"c_{c}") for c in carry],
        (F.col("x1") - 1e-6).alias("x1"), (F.col("y1") - 1e-6).alias("y1"), (F.col("x2") + 1e-6).alias("x2"), (F.col("y2") + 1e-6).alias("y2"),
        *[F.col(c).alias("b" + c) for c in ("x1", "y1", "x2", "y2")],
    )
    met = overlap_pairs(t, d, keys, "r_")
    own = (F.col("x") - half_w, F.col("y") - half_h, F.col("x") + half_w, F.col("y") + half_h)
    other = tuple(F.col("r_b" + c) for c in ("x1", "y1", "x2", "y2"))
    cx, cy = B.center(other)
    met = met.withColumns(
        {
            "_iou": B.iou(own, other),
            "_maha": squared_distance(cx - F.col("x"), cy - F.col("y"), F.col("p00"), noise),
            "_gate": coast_gate(F.col("tsu"), gate),
            "_look": F.when(
                F.col("vector").isNotNull() & F.col("r_vector").isNotNull(),
                F.least(F.greatest(1.0 - V.cosine(F.col("vector"), F.col("r_vector")), F.lit(0.0)), F.lit(1.0)),
            ).when(
                (F.col("name") != "") & (F.col("r_name") != ""), F.when(F.col("name") == F.col("r_name"), 0.1).otherwise(0.8)
            ),
        }
    )
    look = F.col("_look")
    valid = ((F.col("_maha") <= F.col("_gate")) | (F.col("_iou") >= 0.05)) & (look.isNull() | (look <= 0.85))
    space = 0.5 * F.least(F.col("_maha") / F.greatest(F.col("_gate"), F.lit(1e-6)), F.lit(2.0))
    # the weights as written, in the order of the plain formula, so that equal costs are equal to the last bit
    both = float(Decimal(repr(w_iou)) + Decimal(repr(w_space)))
    blind = (w_iou * (1 - F.col("_iou")) + w_space * space) / both
    sighted = w_iou * (1 - F.col("_iou")) + w_space * space + w_look * look
    return met.where(valid).select(
        *keys, F.col("t_id").alias(track), F.col("r_d_id").alias(number), F.when(look.isNull(), blind).otherwise(sighted).alias("cost"),
        *[F.col(f"r_c_{c}").alias(c) for c in carry],
        F.least("x1", "r_x1").alias("_xlo"), F.greatest("x2", "r_x2").alias("_xhi"),
        F.least("y1", "r_y1").alias("_ylo"), F.greatest("y2", "r_y2").alias("_yhi"),
    )


def _matched(pairs: DataFrame, keys: list[str], track: str, number: str, bound: int) -> DataFrame:
    """Least-cost matching of costed pairs, frame by frame.

    A frame goes to the helper whole, which splits it by who shares whom; a pair on its
    own is a match as it stands. Frames with more than `WHOLE_PAIRS` pairs are split
    before into groups that cannot touch, so that no frame has to fit in one place.
    """
    if bound <= WHOLE_PAIRS:
        return _solved(pairs, keys, keys, track, number)
    pairs = stored_table(pairs)
    # fewer than rows / WHOLE_PAIRS frames can pass this filter
    crowded = stored_table(pairs.groupBy(*keys).count().where(F.col("count") > WHOLE_PAIRS).select(*keys))
    whole = _solved(pairs.join(crowded, keys, "left_anti"), keys, keys, track, number)
    split = axis_islands(pairs.join(crowded, keys, "left_semi"), keys, [track, number], bound)
    return whole.unionByName(_solved(split, keys, [*keys, "_ix", "_iy"], track, number))


def _solved(pairs: DataFrame, keys: list[str], group: list[str], track: str, number: str) -> DataFrame:
    """Matching of every group; only groups of more than one pair go to the helper, in group order."""
    slim = pairs.withColumn("_n", F.count("*").over(W.partitionBy(*group))).select(*group, track, number, "cost", "_n")
    types = dict(slim.dtypes)
    out_cols = [*keys, track, number, "cost"]
    ddl = ", ".join(f"`{c}` {types[c]}" for c in out_cols)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_keys(batches, group):
            starts = [0, *turns(batch, group).tolist()]
            ids = [batch.column(c).to_pylist() for c in (track, number)]
            costs = batch.column("cost").to_pylist()
            kept = []
            for a, z in zip(starts, [*starts[1:], batch.num_rows]):
                # numbers in the order of the ids, so that ties fall as they do for the ids
                ranks = [{v: k for k, v in enumerate(sorted(set(side[a:z])))} for side in ids]
                line = {(ranks[0][ids[0][i]], ranks[1][ids[1][i]]): i for i in range(a, z)}
                kept += [line[p] for p in frame_matching({p: costs[i] for p, i in line.items()})]
            yield batch.select(out_cols).take(pa.array(kept, pa.int64()))

    rivals = slim.where("_n > 1").drop("_n").repartition(*group).sortWithinPartitions(*group)
    return slim.where("_n = 1").select(*out_cols).unionByName(rivals.mapInArrow(match, ddl))


def assign_optimal(
    tracks: DataFrame, det: DataFrame, keys: Sequence[str], track: str, number: str, **options
) -> DataFrame:
    """Gated least-cost one-to-one matching per frame; valid pairs are costed in a join."""
    keys = list(keys)
    pairs = candidate_costs(tracks, det, keys, track, number, **options)
    return _matched(pairs, keys, track, number, _pair_bound(tracks, det, keys))


def assign_two_stage(
    tracks: DataFrame, det: DataFrame, keys: Sequence[str], track: str, number: str,
    high: float = 0.5, low: float = 0.1, **options,
) -> tuple[DataFrame, DataFrame]:
    """Strong detections first, then leftover tracks against the weak band.

    Returns the matches (with `stage`) and the strong detections that start new tracks.
    The pairs of both stages are costed once.
    """
    keys = list(keys)
    strong = det.where(F.col("conf") >= high)
    pairs = stored_table(candidate_costs(tracks, det.where(F.col("conf") >= low), keys, track, number, carry=["conf"], **options))
    bound = _pair_bound(tracks, det, keys)
    # the first stage feeds three joins
    first = stored_table(_matched(pairs.where(F.col("conf") >= high), keys, track, number, bound))
    rest = pairs.where(F.col("conf") < high).join(first.select(*keys, track), [*keys, track], "left_anti")
    second = _matched(rest, keys, track, number, bound)
    births = strong.join(first.select(*keys, number), [*keys, number], "left_anti")
    return first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2))), births
