"""Every stage on its predecessor's rows, against plain walks."""

import hashlib

import numpy as np
import tiktoken

import corpus_pipeline
from gridlark.llm.bpe import public_vocabulary
from gridlark.llm.columns import BREAK_CHARS
from tests.llm.test_mixing import reshared
from tests.llm.test_quality import plain_kept
from tests.llm.test_similar import plain_groups
from tests.llm.test_suffixes import plain

SF = "/root/testdata/sf0.001"


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def words(text):
    return [w for w in "".join(" " if c in BREAK_CHARS else c for c in text or "").split(" ") if w]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hard = [(-1, None, None, None, None), (-2, "", "en", "odd", 0), (-3, "solid words here and there " * 3, "en", None, 9)]
    docs = docs.unionByName(spark.createDataFrame(hard, docs.schema))
    rows = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = docs.collect()
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == names[0]:
            assert key(got) == key(r for r in rows if plain_kept(r["text"])) and 50 < len(got) < len(rows)
        elif name == names[1]:
            groups = plain_groups([(r["doc_id"], r["text"]) for r in rows])
            assert key(got) == key(r for r in rows if groups[r["doc_id"]] == r["doc_id"]) and len(got) < len(rows)
        elif name == names[2]:
            rest = [b.decode(errors="replace") for _, _, b in plain([r["text"] for r in rows], corpus_pipeline.REPEAT_BYTES)]
            assert key(got) == key((r["doc_id"], t, r["lang"], r["source"], len(t)) for r, t in zip(rows, rest))
        elif name == names[3]:
            sizes, taken = {}, {}
            for r in rows:
                sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
            for r in got:
                taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
            want = reshared(sizes)
            longest = max(len(words(r["text"])) for r in rows)
            assert set(map(tuple, got)) <= set(map(tuple, rows))
            assert all(abs(taken.get(s, 0) - want[s]) <= longest / 2 + 1 for s in want)
        else:
            ranks, pattern = public_vocabulary()
            theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            texts = {r["doc_id"]: r["text"] for r in rows}
            assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows)
            for r in got:
                ids = np.array(theirs.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
                assert bytes(r["ids"]) == ids and r["n_tokens"] == len(ids) // 4 and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        rows = got


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 0


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
