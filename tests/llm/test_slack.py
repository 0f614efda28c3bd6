"""Packing by minimum bin slack: combinations against brute force, ids against the library."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridlark.llm.registry import table
from gridlark.llm.slack import ROOM, VOCABULARY, Coder, combinations, fullest, op11_minimum_bin_slack, pack_tightly, public_pieces, sequences

SF = "/root/testdata/sf0.001"
HARD = ["", " ", "a<|endoftext|>b <|startoftext|>", "é x ́y", "\x1cfoo\x1d bar", "don't 'S I'll", "x y　z w", "ΑΣ ΣΑΣ.", "한 가 ᆨ", "İI ǅ ß", "1234 ½ ٣", "😀👍🏽 ok", "²³¼ª ÀÉ¿x« don't'S. (a),b! <|x", "I'LL\x85y\xa0z İx"]


def library():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def test_ids_are_the_librarys():
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        coder = Coder(f.read())
    assert coder.wordwise
    theirs = library()
    for text in [*HARD, " \n".join(HARD), "word " * 50_000]:
        for _ in range(2):
            assert np.frombuffer(coder.ids(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    coder.wordwise = False
    assert np.frombuffer(coder.ids(HARD[2]), "<u4").tolist() == theirs.encode(HARD[2], add_special_tokens=False).ids


def test_fullest_and_combinations():
    rng = random.Random(4)
    for _ in range(300):
        room = rng.randrange(5, 40)
        counts = {n: rng.randrange(1, 4) for n in rng.sample(range(1, room + 1), rng.randrange(1, min(6, room) + 1))}
        best = fullest(counts, room)
        longest = max(counts)
        assert best[longest] >= 1 and all(k <= counts[n] for n, k in best.items())
        sums = {sum(a * n for a, n in zip(ks, counts)) for ks in itertools.product(*(range(c + 1) for c in counts.values())) if dict(zip(counts, ks))[longest]}
        assert sum(n * k for n, k in best.items()) == max(s for s in sums if s <= room)
        made = combinations(counts, room)
        assert {n: sum(b.get(n, 0) * times for b, times in made) for n in counts} == counts and len(made) <= 6 * len(counts)
    many = {n: 10**12 + n for n in range(1, 2049)}
    bins = sum(times for _, times in combinations(many, 2048))
    assert bins <= 1.0001 * sum(n * c for n, c in many.items()) / 2048


def check_layout(rows, room):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return by


def test_pieces_are_placed(spark):
    rng = random.Random(8)
    sizes = [rng.choice([64, 64, 64, rng.randrange(0, 65)]) for _ in range(900)]
    schema = "doc_id long, length long, _n string, _before int"
    df = spark.createDataFrame([(k if k % 9 else None, n, "x", 1) for k, n in enumerate(sizes)], schema).repartition(7)
    packed = pack_tightly(df, 64)
    assert packed.columns == [*df.columns, "sequence_id", "offset"]
    rows = packed.collect()
    by = check_layout(rows, 64)
    assert sorted(r["length"] for r in rows) == sorted(sizes) and sorted(by) == list(range(len(by)))
    assert len(by) <= math.ceil(sum(sizes) / 64) + 1
    assert pack_tightly(df.limit(0)).count() == 0
    assert [(r["sequence_id"], r["offset"]) for r in pack_tightly(df.where("length = 0").select("length")).collect()] == [(0, 0)] * sizes.count(0)
    for bad in ([(1, 65)], [(1, -1)], [(1, None)]):
        with pytest.raises(Exception, match="lengths are"):
            pack_tightly(spark.createDataFrame(bad, "doc_id long, length long"), 64).collect()
    with pytest.raises(ValueError, match="offset"):
        pack_tightly(df.withColumnRenamed("_n", "Offset"))


def test_texts_come_back(spark):
    texts = [*HARD, None, "so it goes " * 3000, "same", "same"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    packed = pack_tightly(public_pieces(df, 100), 100)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in sequences(packed).collect()}
    back = {}
    for r in packed.collect():
        back.setdefault(r["doc_id"], []).append((r["piece"], r["start"], whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tolist()))
    theirs = library()
    for k, text in enumerate(texts):
        pieces = sorted(back[k])
        assert [t for _, _, ids in pieces for t in ids] == theirs.encode(text or "", add_special_tokens=False).ids + [0]
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(s == 100 * p for p, s, _ in pieces)


def test_query(spark):
    theirs = library()
    want = {r["doc_id"]: theirs.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in table(spark, SF, "documents").collect()}
    rows = op11_minimum_bin_slack(spark, SF).collect()
    by = check_layout(rows, ROOM)
    assert len(by) <= math.ceil(sum(map(len, want.values())) / ROOM) + 1
    got = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows}
    cut = {d: [ids[a : a + ROOM] for a in range(0, len(ids), ROOM)] for d, ids in want.items()}
    assert got == {(d, p, p * ROOM, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, parts in cut.items() for p, i in enumerate(parts)}
    assert len(rows) == len(got)
