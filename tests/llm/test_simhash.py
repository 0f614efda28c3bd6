"""Fingerprints, keys and groups against plain walks."""

import random

import numpy as np
import pytest
import xxhash

from gridlark.llm.registry import table
from gridlark.llm.simhash import codewords, fingerprint, fuzzy_keys, linked_fingerprints, near_groups
from gridlark.operators.connected import connected

SEP = " \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SEP:
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(pairs):
    """doc -> least doc over links of at most 3 bits; ids may repeat or be missing."""
    fps = sorted({f for _, f in pairs})
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                up[top(a)] = top(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return {(d, f): least.get(top(f)) for d, f in pairs}


def test_codewords_cover_one_bit():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 20000)
    y = x ^ np.where(rng.random(20000) < 0.1, 0, 1 << rng.integers(0, 23, 20000))
    (nx, kx), (ny, ky) = codewords(x), codewords(y)
    assert (kx == ny[:, None]).any(axis=1).all() and (ky == nx[:, None]).any(axis=1).all()


def test_three_bits_always_share_a_key():
    rng = random.Random(2)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), rng.randrange(0, 4)):
            b ^= 1 << i
        keys, rows = fuzzy_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    want = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    got = near_groups(table(spark, sf, "documents")).collect()
    groups = plain_groups(list(want.items()))
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == want and len(got) == len(rows)
    assert all(r["component_id"] == groups[(r["doc_id"], want[r["doc_id"]])] for r in got)


def test_odd_texts():
    for t in [None, "", " \n", "One", "A b", "É a\x0bB c d E", "x " * 70000 + "y", "long\tWords " * 350000]:
        assert fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("most, dense", [(3, 4), (3, 8192), (2, 4), (1, 4), (0, 4)])
def test_links_in_crowded_buckets(spark, most, dense):
    rng = random.Random(most + dense)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = set(seeds) | {rng.getrandbits(64) for _ in range(30)}
    for _ in range(140):
        f = rng.choice(seeds)
        for i in rng.sample(range(64), rng.randrange(1, 6)):
            f ^= 1 << i
        fps.add(f)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    out = connected(linked_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), most, dense)).collect()
    root = {r["node"] % 2**64: r["root"] for r in out}
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= most:
                up[top(a)] = top(b)
    groups, mine = {}, {}
    for f in fps:
        groups.setdefault(top(f), set()).add(f)
        mine.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, 1), (3, "", 2), (2, " ", 3), (5, "same text here now", 4), (5, "same text here now", 4), (None, "Same TEXT here now", 5), (None, "quite another one", 6)]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string, fp long")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(
        [(None, 2), (3, 2), (2, 2), (5, 5), (5, 5), (None, 5), (None, None)], key=str
    )
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
