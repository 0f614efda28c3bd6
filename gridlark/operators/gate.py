"""Change gate on cell grids: background, motion, regions, decision.

Frames carry their grid as an array, one place per cell (`grid_*`), or cells come as
rows of their own. A frame's grid stays one row all the way, so nothing grows with the
cells but the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.operators.components import components, fold_components
from gridlark.operators.ordered import largest_group, number_rows
from gridlark.session import stored_table

KEYS = ["stream_id", "frame_index"]

#: Grids up to this many cells are searched for blobs inside the row.
SMALL_GRID = 64


def _starts(blocks: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """Add `_s`, the value before each block `_b`, where a block maps s to ``_a * s + _c``.

    Maps of `fan` blocks compose to one of the level above, up to a level with few.
    """
    row = F.struct("_b", "_a", "_c")
    walk = lambda rows, start: F.aggregate(
        rows,
        F.struct(start.alias("s"), F.array().cast("array<struct<b:bigint,s:double>>").alias("out")),
        lambda t, r: F.struct(
            (r["_a"] * t["s"] + r["_c"]).alias("s"), F.concat(t["out"], F.array(F.struct(r["_b"].alias("b"), t["s"].alias("s")))).alias("out")
        ),
    )["out"]
    grouped = blocks.withColumn("_g", F.floor(F.col("_b") / fan).cast("bigint")).groupBy(*keys, "_g").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    if (blocks.agg(F.max("_b")).first()[0] or 0) < fan:
        placed = grouped.withColumn("_s", F.lit(0.0))
    else:
        both = F.aggregate(
            "_rows",
            F.struct(F.lit(1.0).alias("_a"), F.lit(0.0).alias("_c")),
            lambda t, r: F.struct((r["_a"] * t["_a"]).alias("_a"), (r["_a"] * t["_c"] + r["_c"]).alias("_c")),
        )
        above = grouped.select(*keys, F.col("_g").alias("_b"), both.alias("_m")).select(*keys, "_b", "_m._a", "_m._c")
        placed = grouped.join(_starts(above, keys, fan).withColumnRenamed("_b", "_g").select(*keys, "_g", "_s"), [*keys, "_g"])
    each = placed.select(*keys, F.explode(walk(F.col("_rows"), F.col("_s"))).alias("_o"))
    return each.select(*keys, F.col("_o.b").alias("_b"), F.col("_o.s").alias("_s"))


def ema_background(
    cells: DataFrame, keys: Sequence[str], index: str, value: str, keep: float = 0.85, block: int = 256, fan: int = 256, size: int | None = None
) -> DataFrame:
    """Running background just before each value, and the distance to it.

    The background starts at the first value and then moves by (1 - keep). Rows follow
    `index`, which may have gaps. A series is cut into blocks of `block` rows; each block
    moves the background by a linear map, the maps give the background at every block's
    start, and the blocks are walked from there. So a long series spreads over many tasks
    and a series of any length gives what a plain walk gives. `size` is a known bound on
    the length of a series, for the row numbers.
    """
    keys = list(keys)
    kind = dict(cells.dtypes)[index]
    slim = cells.select(*keys, index, F.col(value).cast("double").alias("_v"))
    placed = number_rows(slim, keys, [index, "_v"], "_pos", size=size)
    row = F.struct(F.col(index).alias("i"), F.col("_v").alias("v"))
    lists = placed.groupBy(*keys, F.floor((F.col("_pos") - 1) / block).cast("bigint").alias("_b")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    lists = stored_table(lists)  # for the blocks' maps and for the walk
    move = lambda s, r: F.when(s.isNull(), r["v"]).otherwise(keep * s + (1.0 - keep) * r["v"])
    first = F.when(F.col("_b") == 0, F.lit(None).cast("double")).otherwise(F.lit(0.0))
    end = F.aggregate("_rows", first, move)
    scale = F.when(F.col("_b") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(keep), F.size("_rows")))
    starts = _starts(lists.select(*keys, "_b", scale.alias("_a"), end.alias("_c")), keys, fan)
    zero = F.struct(
        F.when(F.col("_b") > 0, F.col("_s")).alias("s"), F.array().cast(f"array<struct<i:{kind},v:double,s:double>>").alias("out")
    )

    def step(a, r):
        entry = F.struct(r["i"].alias("i"), r["v"].alias("v"), a["s"].alias("s"))
        return F.struct(move(a["s"], r).alias("s"), F.concat(a["out"], F.array(entry)).alias("out"))

    out = lists.join(starts, [*keys, "_b"]).select(*keys, F.explode(F.aggregate("_rows", zero, step)["out"]).alias("_o"))
    return out.select(
        *keys, F.col("_o.i").alias(index), F.col("_o.v").alias(value), F.col("_o.s").alias("background"),
        F.abs(F.col("_o.v") - F.col("_o.s")).alias("diff"),
    )


_MAP = "array<struct<a:double,c:double,n:double>>"


def _through(map_: Column, state: Column) -> Column:
    """State of each cell after a block: ``a * s + c``, or `n` where nothing was seen before."""
    return F.zip_with(state, map_, lambda s, m: F.when(m.isNull(), s).when(s.isNull(), m["n"]).otherwise(m["a"] * s + m["c"]))


def _grid_starts(blocks: DataFrame, keys: list[str], fan: int, last: int) -> DataFrame:
    """Add `_s`, the grid before each block `_b`, from the blocks' maps `_m`; `last` is the highest block.

    Maps of `fan` blocks compose to one of the level above, up to a level with few.
    """
    rows = F.array_sort(F.collect_list(F.struct("_b", "_m")))
    grouped = blocks.withColumn("_g", F.floor(F.col("_b") / fan).cast("bigint")).groupBy(*keys, "_g").agg(rows.alias("_rows"))
    if last < fan:
        placed = grouped.withColumn("_s", F.array().cast("array<double>"))
    else:

        def then(t, m):
            both = F.struct(
                (m["a"] * t["a"]).alias("a"), (m["a"] * t["c"] + m["c"]).alias("c"), F.coalesce(m["a"] * t["n"] + m["c"], m["n"]).alias("n")
            )
            return F.when(t.isNull(), m).when(m.isNull(), t).otherwise(both)

        composed = F.aggregate("_rows", F.array().cast(_MAP), lambda t, r: F.zip_with(t, r["_m"], then))
        above = _grid_starts(grouped.select(*keys, F.col("_g").alias("_b"), composed.alias("_m")), keys, fan, last // fan)
        placed = grouped.join(above.withColumnRenamed("_b", "_g"), [*keys, "_g"])
    zero = F.struct(F.col("_s").alias("s"), F.array().cast("array<struct<b:bigint,s:array<double>>>").alias("out"))
    walked = F.aggregate(
        "_rows", zero,
        lambda t, r: F.struct(
            _through(r["_m"], t["s"]).alias("s"), F.concat(t["out"], F.array(F.struct(r["_b"].alias("b"), t["s"].alias("s")))).alias("out")
        ),
    )
    return placed.select(*keys, F.explode_outer(walked["out"]).alias("_o")).select(*keys, F.col("_o.b").alias("_b"), F.col("_o.s").alias("_s"))


def grid_background(
    frames: DataFrame, keys: Sequence[str], index: str, grid: str = "grid", keep: float = 0.85, block: int = 256, fan: int = 256,
    position: str | None = None, size: int | None = None,
) -> DataFrame:
    """Running background of each cell just before a frame, and the distance to it, as arrays like `grid`.

    A null cell has no reading: its background stays as it was. `position` names a column
    that numbers a stream's frames from 1 already, `size` is a known bound on the frames of
    a stream. Streams are cut into blocks of `block` frames as in `ema_background`; while
    none is longer than a block, each is walked as it is.
    """
    keys = list(keys)
    kind = dict(frames.dtypes)[index]
    slim = frames.select(*keys, index, F.col(grid).cast("array<double>").alias("_v"), *([F.col(position).alias("_pos")] if position else []))
    if size is None:
        size = largest_group(frames, keys)
    placed = slim if position else number_rows(slim, keys, [index, "_v"], "_pos", size=size)
    row = F.struct(F.col(index).alias("i"), F.col("_v").alias("v"))
    lists = placed.groupBy(*keys, F.floor((F.col("_pos") - 1) / block).cast("bigint").alias("_b")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    values = lambda r: F.coalesce(r["v"], F.array().cast("array<double>"))
    move = lambda s, v: F.when(v.isNull(), s).otherwise(F.coalesce(keep * s + (1.0 - keep) * v, v))
    if size <= block:
        started = lists.withColumn("_s", F.array().cast("array<double>"))
    else:
        lists = stored_table(lists)  # for the blocks' maps and for the walk

        def fold(t, v):
            a, c = F.coalesce(t["a"], F.lit(1.0)), F.coalesce(t["c"], F.lit(0.0))
            moved = F.struct((keep * a).alias("a"), (keep * c + (1.0 - keep) * v).alias("c"), move(t["n"], v).alias("n"))
            return F.when(v.isNull(), t).otherwise(moved)

        maps = F.aggregate("_rows", F.array().cast(_MAP), lambda t, r: F.zip_with(t, values(r), fold))
        starts = _grid_starts(lists.select(*keys, "_b", maps.alias("_m")), keys, fan, (size - 1) // block)
        started = lists.join(starts, [*keys, "_b"])
    zero = F.struct(
        F.col("_s").alias("s"), F.array().cast(f"array<struct<i:{kind},v:array<double>,s:array<double>>>").alias("out")
    )

    def step(a, r):
        entry = F.struct(r["i"].alias("i"), r["v"].alias("v"), a["s"].alias("s"))
        return F.struct(F.zip_with(a["s"], values(r), move).alias("s"), F.concat(a["out"], F.array(entry)).alias("out"))

    # no list is empty; a plain explode would compute it once more to filter by its size
    out = started.select(*keys, F.explode_outer(F.aggregate("_rows", zero, step)["out"]).alias("_o"))
    out = out.select(*keys, F.col("_o.i").alias(index), F.col("_o.v").alias(grid), F.col("_o.s").alias("_s"))
    # a grid's own cells; the state also has those of larger grids before
    before = F.transform(grid, lambda v, i: F.get("_s", i))
    out = out.select(*keys, index, grid, before.alias("background"))
    return out.withColumn("diff", F.zip_with(grid, "background", lambda v, s: F.abs(v - s)))


def grid_motion(grids: DataFrame, floor: float = 16.0) -> DataFrame:
    """Add `motion_frac` and `energy` to frames of `grid_background`; `motion` says the same of cells."""
    known = F.filter("diff", lambda d: d.isNotNull())
    hot = F.size(F.filter("diff", lambda d: d > floor)).cast("double")
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda t, d: t + d) / F.size(known))
    per = grids.withColumns({"motion_frac": F.when(F.size("diff") > 0, hot / F.size("diff")), "_mean": mean})
    return per.withColumn("energy", _energy()).drop("_mean")


def _energy() -> Column:
    return F.when(F.col("_mean").isNull(), F.lit(0.0)).otherwise(F.col("_mean") + 1000.0 * F.col("motion_frac"))


def motion(diffs: DataFrame, floor: float = 16.0) -> DataFrame:
    """Share of changed cells and the gate energy of each frame."""
    changed = F.coalesce((F.col("diff") > floor).cast("double"), F.lit(0.0))
    per = diffs.groupBy(*KEYS).agg(F.avg(changed).alias("motion_frac"), F.avg("diff").alias("_mean"))
    return per.select(*KEYS, "motion_frac", _energy().alias("energy"))


def _framed(b, scale: float, pad: int, width: int, height: int):
    """Cell edges as a padded box inside the frame."""
    edge = lambda c, sign: (c / scale).cast("int") + sign * pad
    return B.clip((edge(b[0], -1), edge(b[1], -1), edge(b[2], 1), edge(b[3], 1)), width, height)


def regions(
    diffs: DataFrame, floor: float = 16.0, min_cells: int = 2, scale: float = 1.0, pad: int = 16, width: int = 640, height: int = 480,
    cells_per_frame: int | None = None,
) -> DataFrame:
    """Blobs of changed cells as padded boxes; cells touching at a corner belong together.

    `cells_per_frame` is a known bound on the grid size and saves looking it up.
    """
    hot = diffs.where(F.col("diff") > floor).select(
        *KEYS, F.col("cell_x").cast("double").alias("x"), F.col("cell_y").cast("double").alias("y"),
        (F.col("cell_y").cast("bigint") * (1 << 20) + F.col("cell_x")).alias("cell"),
    )
    blobs = components(hot, KEYS, "cell", 1.5, size=cells_per_frame).groupBy(*KEYS, "component").agg(
        F.count("*").alias("n_cells"), F.min("x").alias("x1"), F.min("y").alias("y1"),
        (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"),
    )
    big = blobs.where(F.col("n_cells") >= min_cells)
    named = big.withColumns(dict(zip(("x1", "y1", "x2", "y2"), _framed(B.box(), scale, pad, width, height))))
    return named.where(B.area_int(B.box()) > 0).select(*KEYS, "component", "n_cells", "x1", "y1", "x2", "y2")


def grid_regions(
    grids: DataFrame, across: int, floor: float = 16.0, min_cells: int = 2, scale: float = 1.0, pad: int = 16, width: int = 640, height: int = 480,
    cells_per_frame: int | None = None,
) -> DataFrame:
    """Add `regions`, the boxes that `regions` finds, to frames of `grid_background`.

    A grid has `across` cells a row. Small grids are searched inside the row; the cells
    of larger ones are linked as rows and their boxes brought back to the frame.
    """
    if cells_per_frame is None:
        cells_per_frame = grids.agg(F.max(F.size("diff"))).first()[0] or 0
    x, y = lambda i: i % across, lambda i: F.floor(i / across).cast("bigint")
    if cells_per_frame > SMALL_GRID:
        cells = grids.select(*KEYS, F.posexplode("diff").alias("_i", "diff"))
        cells = cells.select(*KEYS, x(F.col("_i")).alias("cell_x"), y(F.col("_i")).alias("cell_y"), "diff")
        found = regions(cells, floor, min_cells, scale, pad, width, height, cells_per_frame)
        box = F.struct("component", "n_cells", "x1", "y1", "x2", "y2")
        per = found.groupBy(*KEYS).agg(F.collect_list(box).alias("regions"))
        return grids.join(per, KEYS, "left").withColumn("regions", F.coalesce("regions", F.array()))

    def point(d, i):
        at = F.struct(x(i).cast("double").alias("x"), y(i).cast("double").alias("y"), (y(i) * (1 << 20) + x(i)).alias("id"))
        return F.when(d > floor, at)

    def box(c):
        of = lambda n: F.transform(c, lambda p: p[n])
        edges = (F.array_min(of("x")), F.array_min(of("y")), F.array_max(of("x")) + 1, F.array_max(of("y")) + 1)
        named = zip(("x1", "y1", "x2", "y2"), _framed(edges, scale, pad, width, height))
        n = F.size(c).cast("bigint").alias("n_cells")
        return F.struct(F.array_min(of("id")).alias("component"), n, *[v.alias(k) for k, v in named])

    hot = grids.withColumn("_hot", F.filter(F.transform("diff", point), lambda p: p.isNotNull()))
    # fewer cells than a region needs are not linked
    linked = F.when(F.size("_hot") >= min_cells, fold_components(F.col("_hot"), 1.5)).otherwise(F.array())
    blobs = hot.withColumn("_blobs", linked).drop("_hot")
    boxes = F.transform(F.filter("_blobs", lambda c: F.size(c) >= min_cells), box)
    real = lambda r: B.area_int(tuple(r[n] for n in ("x1", "y1", "x2", "y2"))) > 0
    return blobs.withColumn("regions", F.filter(boxes, real)).drop("_blobs")


def gate(energies: DataFrame, rois: DataFrame, min_energy: float = 6.0) -> DataFrame:
    """Skipped and triggered flags per frame; the first frame of a stream is skipped."""
    found = rois.groupBy(*KEYS).agg(F.count("*").alias("n_rois"))
    return decide(energies.join(found, KEYS, "left").withColumn("n_rois", F.coalesce("n_rois", F.lit(0).cast("bigint"))), min_energy)


def decide(joined: DataFrame, min_energy: float = 6.0) -> DataFrame:
    """`gate` of frames that have `energy` and `n_rois` already."""
    loud = (F.col("frame_index") > 1) & (F.col("energy") >= min_energy)
    hit = loud & (F.col("n_rois") > 0)
    return joined.select(
        *KEYS, "energy", F.when(hit, F.col("n_rois")).otherwise(F.lit(0).cast("bigint")).alias("n_rois"),
        hit.alias("triggered"), (~hit).alias("skipped"),
    )
