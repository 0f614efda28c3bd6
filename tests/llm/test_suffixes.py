"""Removed bytes against a plain walk over all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gridlark.llm import suffixes
from gridlark.llm.registry import table
from gridlark.llm.suffixes import SuffixIndex, entries, op1_suffix_array_dedup, remove_repeats, text_keys, window_hashes, without_repeats


def plain(texts, length):
    """Per text: bytes lost, spans, what is left."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((sum(hit), spans, bytes(b for b, h in zip(d, hit) if not h)))
    return out


def mine(spark, texts, length, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    h1, h2 = text_keys()
    joined = docs.withColumn("h1", h1).withColumn("h2", h2).join(remove_repeats(docs, length=length, **kw), ["h1", "h2"], "left").collect()
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept"]) for r in joined}
    assert len(got) == len(joined) == len(texts)
    return [(0, 0, (t or "").encode()) if got[i][0] is None else (got[i][0], got[i][1], bytes(got[i][2])) for i, t in enumerate(texts)]


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(4)]
    base = " ".join(word() for _ in range(60))
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            words = base.split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
        elif kind == 1:
            texts.append(" ".join(word() for _ in range(20)) + rng.choice(passages) + word())
        elif kind == 2:
            texts.append((word() + " ") * rng.randrange(1, 60))
        else:
            texts.append(" ".join(word() for _ in range(rng.randrange(0, 80))))
    return texts + [None, "", "a" * 300, "a" * 63, "a" * 64, texts[0], texts[0], texts[4], "x" * 500 + texts[4]]


@pytest.mark.parametrize("crowd, batches", [(256, 4), (3, 3), (0, 1), (20, 5)])
def test_against_all_strings(spark, crowd, batches):
    texts = corpus(crowd, 120)
    assert mine(spark, texts, 64, crowd=crowd, batches=batches) == plain(texts, 64)


def test_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_BLOCK", 500)
    texts = corpus(9, 40)
    long = np.frombuffer(" ".join(t for t in texts if t).encode(), np.uint8)
    cut = [x.tolist() for x in entries(long, 64)]
    monkeypatch.setattr(suffixes, "_BLOCK", 1 << 22)
    assert cut == [x.tolist() for x in entries(long, 64)]


def test_equal_windows_choose_equal_heads():
    rng = np.random.default_rng(3)
    same = rng.integers(97, 100, 400, np.uint8)
    a, b = (np.concatenate([rng.integers(97, 100, n, np.uint8), same, rng.integers(97, 100, 90, np.uint8)]) for n in (77, 203))
    for data, at in ((a, 77), (b, 203)):
        keys, lo, hi = entries(data, 128)
        owner = np.searchsorted(lo, np.arange(at, at + 400 - 127), side="right") - 1
        assert lo[0] == 0 and hi[-1] == len(data) - 128 and (lo[1:] == hi[:-1] + 1).all()
        if at == 77:
            first = keys[owner]
    assert (first == keys[owner]).all()
    assert len(set(window_hashes(np.tile(same, 3), 128))) == 400


def test_levels_merge_geometrically(spark, tmp_path):
    index, seen, rng = SuffixIndex(spark, str(tmp_path)), Counter(), random.Random(4)
    for step in range(1, 6):
        batch = [rng.randrange(60) for _ in range(20)]
        got = {r["key"]: r["n"] for r in index.add(spark.createDataFrame([(k,) for k in batch], "key long")).collect()}
        seen.update(batch)
        assert got == {k: seen[k] for k in batch if seen[k] > 1}
        assert sorted(index.levels) == [i for i in range(4) if step >> i & 1]


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in rows), plain([r["text"] for r in rows], 400)))
    got = op1_suffix_array_dedup(spark, sf).collect()
    assert len(got) == len(rows) and sum(r["n_spans"] for r in got) > 10
    for r in got:
        n, spans, rest = want[r["doc_id"]]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, spans, hashlib.sha256(rest).hexdigest())


def test_rows_stay_and_names_clash(spark):
    rows = [(1, "a" * 70, "x", 5), (1, "a" * 70, "x", 5), (None, None, None, None), (2, "é" * 40, "y", 6), (3, "k", "h", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string, n_removed long")
    out = without_repeats(docs, length=64)
    assert out.columns == ["doc_id", "text", "h1", "n_removed", "_n_removed"]
    got = sorted(((r["doc_id"], r["text"], r["_n_removed"]) for r in out.collect()), key=str)
    assert got == sorted([(1, "", 70), (1, "", 70), (None, None, 0), (2, "", 80), (3, "k", 0)], key=str)
    assert without_repeats(docs.limit(0), length=64).count() == 0
