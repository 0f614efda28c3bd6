"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits the vectors again and again at the middle of a random projection.
Vectors close to a split go down both sides, so a close pair rarely parts, and what one
tree parts another keeps together. Vectors are compared within leaves, true pairs are
verified there and counted in one leaf only, and links are joined to components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.columns import broadcast_if_small
from gridlark.llm.registry import query, table
from gridlark.operators.connected import connected
from gridlark.session import cut_lineage

LEAST_COSINE = 0.98
TREES = 6
LEAF = 512  # vectors of one label that a leaf is meant to hold
CAP = 4096  # vectors that are compared in one task; larger leaves are compared in blocks
SPILL = 0.5  # overlap on each side of a split, in typical projected distances of a pair
SAMPLE = 20_000  # vectors on which split points are fitted


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows."""
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Directions and split points; a node below the fitted ones splits at the tree's middle."""

    def __init__(self, trees: int, depth: int, spill: float, least_cosine: float, seed: int):
        self.trees, self.depth, self.seed = trees, depth, seed
        self.radius = spill * math.sqrt(2 - 2 * least_cosine)
        self.splits: dict[int, list[list[dict[int, float]]]] = {}

    def directions(self, dim: int) -> np.ndarray:
        d = np.random.default_rng([self.seed, dim]).standard_normal((self.trees * max(self.depth, 1), dim))
        return d / np.sqrt((d * d).sum(axis=1, keepdims=True))

    def fit(self, dim: int, x: np.ndarray, least: int = 16) -> None:
        """Middles of all nodes that hold at least `least` of the unit vectors `x`."""
        seen = (x @ self.directions(dim).T).reshape(len(x), self.trees, max(self.depth, 1))
        self.splits[dim] = []
        for t in range(self.trees):
            node, levels = np.zeros(len(x), np.int64), []
            for level in range(self.depth):
                p = seen[:, t, level]
                middles = {-1: float(np.median(p))}
                order = np.argsort(node, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    if len(at) >= least:
                        middles[int(node[at[0]])] = float(np.median(p[at]))
                levels.append(middles)
                node = 2 * node + (p > self._middles(middles, node))
            self.splits[dim].append(levels)

    @staticmethod
    def _middles(middles: dict[int, float], node: np.ndarray) -> np.ndarray:
        known, back = np.unique(node, return_inverse=True)
        return np.array([middles.get(int(k), middles[-1]) for k in known])[back]

    def leaves(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the leaves they lie in; several per tree where splits spill."""
        seen = (x @ self.directions(dim).T).reshape(len(x), self.trees, max(self.depth, 1))
        margin = self.radius / math.sqrt(dim)
        rows, leaves = [], []
        for t in range(self.trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                middles = self.splits[dim][t][level] if dim in self.splits else {-1: 0.0}
                off = seen[row, t, level] - self._middles(middles, node)
                left, right = off <= margin, off > -margin
                row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
            rows.append(row)
            leaves.append((np.int64(t) << 48) + node)
        return np.concatenate(rows), np.concatenate(leaves)


def _forest(vectors: DataFrame, least_cosine: float, trees: int, leaf: int, spill: float, sample: int, seed: int) -> Forest:
    largest = vectors.groupBy("label", "dim").count().groupBy().agg(F.max("count"), F.sum("count")).first()
    most, total = largest[0] or 0, largest[1] or 0
    forest = Forest(trees, max(0, math.ceil(math.log2(max(1, most / leaf)))), spill, least_cosine, seed)
    if forest.depth:
        part = vectors.select("dim", "vector")
        if total > sample:
            part = part.sample(fraction=sample / total, seed=seed)
        rows = part.limit(2 * sample).collect()  # the bound of the sample, never met in practice
        for dim in {r["dim"] for r in rows}:
            forest.fit(dim, _unit(np.array([r["vector"] for r in rows if r["dim"] == dim]).ravel(), dim))
    return forest


def _placed(vectors: DataFrame, forest: Forest) -> DataFrame:
    """A row per vector and leaf, with all leaves of the vector beside it."""
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def run(stream):
        for batch in stream:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _unit(part.column("vector").flatten().to_numpy(zero_copy_only=False), int(dim))
                row, leaf = shared.value.leaves(int(dim), x)
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                every = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf))
                wide = pa.RecordBatch.from_arrays([*part.columns, every], names=[*part.schema.names, "leaves"])
                for at in range(0, len(row), 4096):
                    take = wide.take(pa.array(row[at : at + 4096]))
                    yield pa.RecordBatch.from_arrays([*take.columns, pa.array(leaf[at : at + 4096])], names=[*take.schema.names, "leaf"])

    schema = ", ".join(f"{c} {t}" for c, t in vectors.dtypes)
    return vectors.mapInArrow(run, f"{schema}, leaves array<bigint>, leaf bigint")


def _first_shared(leaves: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least leaf that both rows of each pair lie in; every pair shares one."""
    out = np.full(len(i), np.iinfo(np.int64).max)
    for a in range(leaves.shape[1]):
        mine = leaves[i, a]
        both = (mine[:, None] == leaves[j]).any(axis=1) & (mine >= 0)
        out = np.where(both, np.minimum(out, mine), out)
    return out


def _compare(t: pa.Table, least_cosine: float) -> pa.Table:
    """Links within a leaf, or between two blocks of one: per vector the number of other
    vectors whose pair belongs to this leaf, and a vector it hangs together with."""
    dim = t.column("dim")[0].as_py()
    x = _unit(t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), dim)
    lists = t.column("leaves").to_pylist()
    leaves = np.full((len(lists), max(map(len, lists))), -1, np.int64)
    for k, v in enumerate(lists):
        leaves[k, : len(v)] = v
    here, block = t.column("leaf")[0].as_py(), t.column("block").to_numpy()
    copies = t.column("copies").to_numpy()
    two = t.column("one")[0].as_py() != t.column("other")[0].as_py()
    linked, counts = np.zeros((len(x), len(x)), bool), np.zeros(len(x), np.int64)
    for at in range(0, len(x), 512):
        close = x[at : at + 512] @ x.T >= least_cosine
        if two:
            close &= block[at : at + 512, None] != block[None, :]
        close[np.arange(len(close)), np.arange(at, at + len(close))] = False
        linked[at : at + 512] = close
        i, j = np.nonzero(close)
        i = i + at
        for part in range(0, len(i), 100_000):
            a, b = i[part : part + 100_000], j[part : part + 100_000]
            own = _first_shared(leaves, a, b) == here
            np.add.at(counts, a[own], copies[b[own]])
    linked |= linked.T
    root, left = np.arange(len(x)), linked.any(axis=1)
    for seed in np.flatnonzero(left):
        if not left[seed]:
            continue
        left[seed], edge = False, np.array([seed])
        while len(edge):
            reached = linked[edge].any(axis=0) & left
            left[reached] = False
            edge = np.flatnonzero(reached)
            root[edge] = seed
    some = np.flatnonzero((counts > 0) | (root != np.arange(len(x))))
    node = t.column("node").combine_chunks()
    return pa.table({"node": node.take(pa.array(some)), "n": counts[some], "root": node.take(pa.array(root[some]))})


def near_vectors(
    vectors: DataFrame,
    least_cosine: float = LEAST_COSINE,
    trees: int = TREES,
    leaf: int = LEAF,
    cap: int = CAP,
    spill: float = SPILL,
    sample: int = SAMPLE,
    seed: int = 1,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row ``(vec_id, embedding, label)``.

    Links are pairs of equal, non-null label and a cosine of at least `least_cosine` in
    double precision. A vector that is null, empty, zero or holds a null or non-finite
    component links with nothing, nor do vectors of different lengths. Equal vectors of a
    label collapse to one with a count first, which links them all. `component_id` is the
    least vec_id reachable; repeated ids are rows of their own, and a null id names a
    component only where there is no other.

    Pairs that no tree keeps in one leaf are missed: recall is measured in the tests.
    Split points come from a sample of about `sample` vectors; all vectors are placed.
    Leaves with more than `cap` vectors are compared block by block, exactly. Pairs
    never leave the task that finds them.
    """
    good = F.size("embedding") > 0
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = good & ~bad & F.exists("embedding", lambda v: v != 0) & F.col("label").isNotNull()
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(good, F.lit(False)).alias("good"))
    kind = f"struct<id:{dict(vectors.dtypes)['vec_id']},h:bigint>"
    keyed = rows.where("good").withColumn("h", F.xxhash64("label", "embedding"))
    single = keyed.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.first("h").alias("h"), F.count("*").alias("copies"))
    single = cut_lineage(
        single.select("label", F.size("embedding").alias("dim"), F.struct("id", "h").cast(kind).alias("node"), F.col("embedding").alias("vector"), "copies")
    )
    forest = _forest(single, least_cosine, trees, leaf, spill, sample, seed)
    placed = _placed(single, forest)
    held = cut_lineage(placed.groupBy("label", "dim", "leaf").count().where(F.col("count") > cap))
    blocks = F.ceil(F.col("count") / cap).cast("int")
    placed = placed.join(broadcast_if_small(held.withColumn("blocks", blocks).drop("count")), ["label", "dim", "leaf"], "left")
    placed = placed.withColumn("block", F.pmod(F.col("node.h"), F.coalesce("blocks", F.lit(1))).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    placed = placed.withColumn("with", F.explode(others)).withColumns({"one": F.least("block", "with"), "other": F.greatest("block", "with")}).drop("with", "blocks")
    # each vector meets the others of its own block once, and those of each other block once
    found = placed.groupBy("label", "dim", "leaf", "one", "other").applyInArrow(
        lambda t: _compare(t, least_cosine), f"node {kind}, n bigint, root {kind}"
    )
    found = cut_lineage(found)
    roots = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = single.select("node", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("node.id").alias("component_id"))
    links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = cut_lineage(named.join(least, "root").select("node", links, "component_id"))
    named = single.select("label", F.col("vector").alias("embedding"), "node").join(named, "node").drop("node")
    linked = keyed.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op2_projection_forest")
def op2_projection_forest(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
