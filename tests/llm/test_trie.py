"""The prefix trie against a plain walk, whole and cut into many shards."""

import hashlib
import random
import zlib

import pytest

from gridlark.llm.registry import ORACLES, table
from gridlark.llm.trie import CODE, Tree, middle_first, op13_conversation_trie, prefix_trie, shared_openings, shared_turns, turn_sequences
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, shard string, name string"


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain_trie(sequences):
    """Node rows of ``{conv_id: turns}``, each node by its opening."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        (
            min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), len(kids.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(p)))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def got(trie):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in trie.collect())


def test_tree_and_halves():
    rng = random.Random(1)
    sequences = {tuple(rng.randrange(4) for _ in range(rng.randrange(6))) for _ in range(200)}
    tree = Tree()
    where = {s: tree.add(list(s)) for s in sequences}
    assert len(set(where.values())) == len(sequences) and all(tree.add(list(s)) == at for s, at in where.items())
    assert len(tree.code) == len({s[:d] for s in sequences for d in range(len(s) + 1)})
    for n in (0, 1, 2, 9, 100):
        assert sorted(middle_first(n)) == list(range(n))
    assert next(middle_first(9)) == 4
    a, b = b"a" * CODE, b"b" * CODE
    assert [shared_turns(a + a + b, a + a + a), shared_turns(b"", a), shared_turns(a, a + b), shared_turns(a, b)] == [2, 0, 1, 0]


@pytest.mark.parametrize("shards,at_once", [(None, 2_000_000), (13, 2_000_000), (5, 40)])
def test_any_cut_into_shards(spark, shards, at_once):
    rng = random.Random(7)
    opening = [("user", "hi é"), ("assistant", "")]
    sequences = {}
    for c in range(400):
        kind = rng.random()
        body = [("user", f"w{rng.randrange(3)}") for _ in range(rng.randrange(5))]
        sequences[c] = body if kind < 0.3 else opening + body if kind < 0.6 else [("user", "same")] * 3 if kind < 0.9 else []
    long = [("user", f"l{k % 7}") for k in range(200)]
    for c in range(400, 430):  # neighbours share more turns than one round hands up
        sequences[c] = long[: rng.randrange(60, 201)] + [("x", str(rng.randrange(2)))]
    rows = [(c, d, r, t) for c, turns in sequences.items() for d, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = spark.createDataFrame([(c,) for c in sequences], "conv_id long")
    assert got(prefix_trie(turn_sequences(turns, convs, ["turn"]), shards, at_once)) == plain_trie(sequences)


def test_nulls_ties_and_names(spark):
    rng = random.Random(3)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, None, None), (9, 2, "user", "b"), (9, 2, "user", "a"), (9, None, "system", "")]
    rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["x", "", None, "é" * 5000])) for c in range(20, 60) for t in range(rng.randrange(12))]
    rows = [(*r, "s", "n") for r in rows]
    table_ = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie(shared_openings(table_))) == plain_trie(plain_rebuilt(rows))
    assert prefix_trie(shared_openings(table_.limit(0))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(op13_conversation_trie(spark, SF)) == plain_trie(plain_rebuilt(rows))
    assert difference(op13_conversation_trie(spark, SF), connect(SF), ORACLES["op13_conversation_trie"]) is None
