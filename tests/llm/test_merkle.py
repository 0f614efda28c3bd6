"""The manifest against a plain walk over lists of digests."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridlark.llm.columns import numbered
from gridlark.llm.merkle import folded, leaf_digest, merkle_proofs, op12_merkle_manifest, proof
from gridlark.llm.registry import ORACLES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, arity):
    """The top, and per leaf the siblings left and right on the way."""
    paths = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + arity, len(nodes))) for a in range(0, len(nodes), arity)]
        for run in runs:
            for i in run:
                for k in under[i]:
                    paths[k].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        under = [[k for i in run for k in under[i]] for run in runs]
        nodes = [h(*(nodes[i] for i in run)) for run in runs]
    return nodes[0], paths


def plain(rows, arity):
    """``(doc_id, leaf, subroot, root, proof, folded from 'f')`` of rows ``(doc_id, grp, leaf)``."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in names:
        line = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        tops[g] = (line, *climb([r[2] for r in line], arity))
    root, upper = climb([tops[g][1] for g in names], arity)
    out = []
    for g, above in zip(names, upper):
        line, top, paths = tops[g]
        for r, path in zip(line, paths):
            at = "f"
            for left, right in path + above:
                at = h(left, at, right)
            out.append((r[0], r[2], top, root, h(*(a + b for a, b in path + above)), at))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_any_shape(spark, arity):
    rng = random.Random(arity)
    rows = [(k if rng.random() < 0.95 else rng.choice([None, 3]), rng.choice(["a", "a", "a", "é", "", None, "b b"]), h(str(k % 97))) for k in range(333)]
    rows += [(5, "lone", h("x"))] + [(k, f"g{k}", h(str(k))) for k in range(arity**2)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, grp string, leaf string, _text string, idx int").repartition(5)
    out = merkle_proofs(df, "grp", ["doc_id"], arity=arity)
    assert out.columns == ["doc_id", "grp", "leaf", "_text", "idx", "subroot", "root", "path"]
    got = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")), folded(F.lit("f"), F.col("path"))).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, arity)
    assert out.where(folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_few_rows_and_names(spark):
    schema = "doc_id long, grp string, leaf string"
    one = merkle_proofs(spark.createDataFrame([(None, None, h("x"))], schema), "grp", ["doc_id"]).first()
    assert one["subroot"] == one["root"] == h("x") and one["path"] == []
    assert merkle_proofs(spark.createDataFrame([], schema), "grp", ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="root"):
        merkle_proofs(spark.createDataFrame([], schema + ", Root int"), "grp", ["doc_id"])


def test_leaf_digest(spark):
    df = spark.createDataFrame([(1, None, "é", "")], "a long, b string, c string, d string")
    assert df.select(leaf_digest(*map(F.col, "abcd"))).first()[0] == h("1:1-2:é0:")


def test_numbers(spark):
    rows = [(g, v) for g in ("a", None) for v in (3, None, 1, 1)] + [("c", 1)]
    df = spark.createDataFrame(rows, "g string, _part int").repartition(4)
    out = numbered(df, ["g"], ["_part"], "at", "n")
    assert out.columns == ["g", "_part", "at", "n"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(g, v, k, 4) for g in ("a", None) for k, v in enumerate((None, 1, 1, 3))] + [("c", 1, 0, 1)], key=str)


def test_query(spark):
    out = op12_merkle_manifest(spark, SF)
    assert difference(out, connect(SF), ORACLES["op12_merkle_manifest"]) is None
    tally = {r["verified"]: r["count"] for r in out.groupBy("verified").count().collect()}
    assert tally[False] > 30 and tally[True] > 100
