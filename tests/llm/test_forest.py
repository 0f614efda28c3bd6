"""Links, components and recall of the forest against brute force."""

import math

import numpy as np
import pytest

from gridlark.llm.forest import near_vectors
from gridlark.llm.registry import table

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def brute(rows, least=0.98):
    """vec row number -> (links, component)."""
    def ok(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    good = [i for i, (_, v, label, _) in enumerate(rows) if ok(v, label)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in good}
    unit = {i: v / abs(v).max() for i, v in unit.items()}
    unit = {i: v / math.sqrt((v * v).sum()) for i, v in unit.items()}
    for a, i in enumerate(good):
        for j in good[:a]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                n[i] += 1
                n[j] += 1
                up[top(i)] = top(j)
    least_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least_id[top(i)] = min(r[0], least_id.get(top(i), r[0]))
    return [(r[0], n[i], least_id.get(top(i))) for i, r in enumerate(rows)]


def clustered(seed, n, dim=16, labels=3, near=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + near * rng.standard_normal(dim) * rng.integers(0, 3)
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(labels)), "x"))
    return rows


def got(df):
    out = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)


@pytest.mark.parametrize("leaf, cap, trees", [(512, 4096, 6), (40, 4096, 8), (30, 25, 8), (512, 37, 2)])
def test_against_all_pairs(spark, leaf, cap, trees):
    rows = clustered(leaf + cap, 600) + [(1000 + i, clustered(5, 6)[0][1], 1, "x") for i in range(80)]
    mine = got(near_vectors(spark.createDataFrame(rows, SCHEMA), leaf=leaf, cap=cap, trees=trees))
    want = sorted(brute(rows), key=str)
    assert len(mine) == len(want)
    found, there = sum(m[1] for m in mine), sum(w[1] for w in want)
    by = {w[0]: w[1] for w in want}
    assert all(m[1] <= by[m[0]] for m in mine) and found >= 0.98 * there
    if leaf == 512:
        assert mine == want


def test_recall_in_deep_trees(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((3000, 64))
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    pair = 0.981 * base + math.sqrt(1 - 0.981**2) * noise  # hardly over the bound
    rows = [(i, [float(x) for x in v], 0, "x") for i, v in enumerate(np.concatenate([base, pair]))]
    out = near_vectors(spark.createDataFrame(rows, SCHEMA), leaf=12, sample=2000).collect()
    assert sum(r["n_links"] for r in out) / 6000 > 0.97


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0, "a"), (2, [2.0, 0.0], 0, "b"), (2, [2.0, 0.0], 0, "b"), (None, [1.0, 0.001], 0, "c"), (3, None, 0, "d"), (4, [0.0, 0.0], 0, "e")]
    rows += [(5, [nan, 1.0], 0, "f"), (6, [inf, 1.0], 0, "g"), (7, [1.0, None], 0, "h"), (8, [1.0, 0.0], None, "i"), (9, [], 0, "j"), (10, [1.0, 0.0, 0.0], 0, "k")]
    rows += [(11, [3e38, 3e38], 0, "l"), (12, [1e-38, 1e-38], 0, "m"), (None, [0.0, 0.0], 0, "n"), (13, [1.0, 0.0], 1, "o")]
    out = near_vectors(spark.createDataFrame(rows, SCHEMA))
    mine = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()), key=str)
    assert mine == sorted(brute(rows), key=str)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table(spark):
    rows = [tuple(r) + ("x",) for r in table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding", "label").collect()]
    mine = got(near_vectors(table(spark, "/root/testdata/sf0.001", "embeddings")))
    assert mine == sorted(brute(rows), key=str)
