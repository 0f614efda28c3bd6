"""Components of graphs with awkward shapes against union-find."""

import random

import pytest

from gridlark.operators.connected import connected


def find(links):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def shuffled_chain(n, seed):
    ids = random.Random(seed).sample(range(10 * n), n)
    return list(zip(ids, ids[1:]))


def graphs():
    rng = random.Random(11)
    yield "chain", shuffled_chain(1500, 2)
    yield "hub", [(0 if i % 2 else 5000, i) for i in range(1, 3000)] + [(5000, 1)]
    yield "sparse", [(rng.randrange(4000), rng.randrange(4000)) for _ in range(3000)]


@pytest.mark.parametrize("links", [g for _, g in graphs()], ids=[n for n, _ in graphs()])
def test_roots(spark, links):
    out = connected(spark.createDataFrame(links, "a long, b long")).collect()
    want = {k: v for k, v in find([l for l in links if l[0] != l[1]]).items()}
    assert len(out) == len(want) and {r["node"]: r["root"] for r in out} == want


def test_none_and_loops(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected(spark.createDataFrame([(1, 1), (None, 2), (3, None)], "a long, b long")).count() == 0


def test_structs(spark):
    links = spark.createDataFrame([(("x", 2), ("x", 1)), (("y", 2), ("y", 3))], "a struct<k:string,i:long>, b struct<k:string,i:long>")
    assert sorted((tuple(r["node"]), tuple(r["root"])) for r in connected(links).collect()) == [
        (("x", 1), ("x", 1)), (("x", 2), ("x", 1)), (("y", 2), ("y", 2)), (("y", 3), ("y", 2))
    ]
