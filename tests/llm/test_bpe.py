"""Ids against the reference tokenizer library, round trips and odd rows."""

import hashlib
import random

import numpy as np
import tiktoken

from gridlark.llm.bpe import Codec, decode, encode, model_bytes, public_vocabulary, round_trip
from gridlark.llm.registry import table

RANKS, PATTERN = public_vocabulary()
THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", "<|endoftext|>", "<s></s>", "a" * 3000, " " * 500 + "x", "\x1c\x1d\x85　 \n\n", "▁▁ ▁", "<unk>", "一乁" * 9, "é😀́\x00\r\n", "'s'S 12٣"]


def test_same_ids_as_the_library():
    rng = random.Random(5)
    codec = Codec(model_bytes(RANKS), PATTERN)
    letters = "ab \n\t'sé中 ñ😀1٣.!\x1c\x85 <|>_ำ́ﬁǅ▁一"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x2FFFF)])) for _ in range(40)) for _ in range(1500)]
    for t in texts:
        ids = codec.encode(t)
        assert list(ids) == THEIRS.encode_ordinary(t), t
        assert codec.decode(ids.tobytes()) == t.encode()


def test_every_token_alone():
    codec = Codec(model_bytes(RANKS), PATTERN)
    for token in random.Random(1).sample(sorted(RANKS), 5000):
        t = token.decode(errors="ignore")
        assert list(codec.encode(t)) == THEIRS.encode_ordinary(t)


def test_documents_round_trip(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in round_trip(docs, RANKS, PATTERN).collect():
        t = texts[r["doc_id"]]
        ids = THEIRS.encode_ordinary(t)
        raw = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, None, "k"), (None, "", None), (2, "two words", "k"), (2, "two words", "k"), (3, "long " * 400000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode(docs, RANKS, PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "_ids"]
    got = decode(out, RANKS, PATTERN, "_ids").collect()
    assert [r["decoded"].decode() for r in got] == [t or "" for _, t, _ in rows]
    assert [r["n_tokens"] for r in got] == [len(THEIRS.encode_ordinary(t or "")) for _, t, _ in rows]
    assert round_trip(docs.limit(0), RANKS, PATTERN).count() == 0
