"""Packed rows: best fit against a plain walk, exact unpacking, odd rows."""

import random

import numpy as np
import pytest
import tiktoken

from gridlark.llm.bpe import public_vocabulary
from gridlark.llm.packing import best_fit, op8_packed_rows, pack, unpack
from gridlark.llm.registry import table

SCHEMA = "doc_id long, ids binary, pieces string"


def plain_best_fit(sizes, row):
    rooms = []
    for n in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(row - n)
    return sorted(rooms)


@pytest.mark.parametrize("row", [1, 7, 64, 100])
def test_best_fit(row):
    rng = random.Random(row)
    for n in (0, 1, 50, 400):
        sizes = np.array([rng.randrange(0, row + 1) for _ in range(n)], np.int64)
        rows = best_fit(sizes, row)
        assert sorted(i for r in rows for i in r) == list(range(n))
        assert sorted(row - int(sizes[r].sum()) for r in rows) == plain_best_fit(sizes.tolist(), row)


def tokens(*ids):
    return np.array(ids, "<u4").tobytes()


def test_round_trip_and_layout(spark):
    rng = random.Random(6)
    docs = {i: [rng.randrange(60000) for _ in range(rng.choice([0, 1, 5, 30, 64, 65, 300]))] for i in range(300)}
    rows = [(i, tokens(*v), "x") for i, v in docs.items()] + [(None, None, "x"), (1000, tokens(*range(5000)), "x"), (7, tokens(*docs[7]), "x")]
    packed = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), row=64, pad=65535, at_once=4000)
    made = packed.collect()
    assert len({r["row_id"] for r in made}) == len(made)
    for r in made:
        ids, places, ends = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(places) == 64 and ends[0] == 0 and ends[-1] == r["n_tokens"] <= 64 and len(ends) == len(r["keys"]) + 1 == len(r["pieces"]) + 1
        assert all((places[a:z] == np.arange(z - a)).all() for a, z in zip(ends, ends[1:]))
        assert (ids[r["n_tokens"] :] == 65535).all() and (places[r["n_tokens"] :] == 0).all()
    back = {}
    for r in unpack(packed).collect():
        back.setdefault(r["key"], []).append((r["piece"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert back.pop(None) == [(0, [])]
    twice = back.pop(7)
    assert len(twice) == 2 * len(set(p for p, _ in twice)) and all(twice.count(x) == 2 for x in twice)
    docs.pop(7)
    docs[1000] = list(range(5000))
    assert {k: [t for _, ids in sorted(v) for t in ids] for k, v in back.items()} == docs
    assert sum(r["n_tokens"] for r in made) > 0.9 * 64 * len(made)


def test_limits_and_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame([(1, tokens(70000), "x")], SCHEMA)
    assert np.frombuffer(pack(wide, row=2, wide=True).first()["ids"], "<u4").tolist() == [70000, 0]
    with pytest.raises(Exception, match="wide=True"):
        pack(wide, row=2).collect()
    text = spark.createDataFrame([("a", tokens(1)), (None, tokens(2))], "doc_id string, ids binary").coalesce(1)
    assert sorted(pack(text, row=4).first()["keys"], key=str) == [None, "a"]


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    ranks, pattern = public_vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = {r["doc_id"]: theirs.encode_ordinary(r["text"]) for r in table(spark, sf, "documents").collect()}
    back = {}
    for r in unpack(op8_packed_rows(spark, sf)).collect():
        back.setdefault(r["key"], []).append((r["piece"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {k: [t for _, ids in sorted(v) for t in ids] for k, v in back.items()} == want
