"""Groups of similar texts against plain sets of shingles."""

import random

import corpus_pipeline
from gridlark.llm.similar import near_groups


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def plain_groups(rows):
    """doc -> least doc over pairs of an index of at least 0.8; ids are distinct."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def test_stage_leaves_one_of_similar_texts(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
    texts = [" ".join(base)]
    for changed in (2, 4, 6):  # five shingles a word: an index of 0.90, 0.82 and 0.74
        words = list(base)
        for at in range(changed):
            words[10 + 30 * at] = f"x{changed}"
        texts.append(" ".join(words))
    assert [5 * len(shingles(texts[0]) & shingles(t)) >= 4 * len(shingles(texts[0]) | shingles(t)) for t in texts] == [True, True, True, False]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts) if k != 2], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 3]
    pair = docs.where("doc_id = 0").union(spark.createDataFrame([(2, texts[2], "en", "s", len(texts[2]))], docs.schema))
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, pair, "").collect()] == [0]


def test_large_groups_around_the_bound(spark):
    rng = random.Random(6)
    texts = ["", None, "One two", "one  TWO", "one two three"]
    for size, spoilt in ((60, 0.012), (60, 0.02), (25, 0.04), (25, 0.003)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(size):
            texts.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < spoilt else w for w in base))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_groups(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert 20 < len(set(want.values())) < 100


def test_nulls_and_repeats(spark):
    rows = [(None, None), (3, ""), (2, " "), (5, "same text here now"), (5, "same text here now"), (None, "Same TEXT here now"), (None, "quite another one")]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(None, 2), (3, 2), (2, 2), (5, 5), (5, 5), (None, 5), (None, None)], key=str)
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def nearly_equal(seed, changed):
    """Texts of 4,000 words that differ in `changed` words."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    other = list(words)
    for at in range(changed):
        other[7 + 90 * at] = "other"
    return " ".join(words), " ".join(other)


def test_simhash_links_before_any_other_key(spark, monkeypatch):
    from gridlark.llm import similar

    texts = [t for seed in range(4) for t in nearly_equal(seed, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [similar.majority_bits([similar.shingle_set(t)]) for t in texts]
    assert all((fps[k] ^ fps[k + 1]).bit_count() <= 3 for k in (0, 2, 4, 6))
    want = {k: k - k % 2 for k in range(8)}
    assert {r["doc_id"]: r["component_id"] for r in near_groups(docs).collect()} == want
    monkeypatch.setattr(similar, "_numbered", lambda rows: None)  # no key but the fingerprint
    assert {r["doc_id"]: r["component_id"] for r in near_groups(docs).collect()} == want


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    from gridlark.llm import similar

    monkeypatch.setattr(similar, "majority_bits", lambda blocks: 5)
    texts = [*nearly_equal(1, 1), *nearly_equal(2, 1), "", "a few words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_groups(docs).collect()} == plain_groups(list(enumerate(texts)))


def test_numbering_reads_stored_rows(spark, monkeypatch):
    from gridlark.llm import similar

    seen, real = [], similar.number_rows
    monkeypatch.setattr(similar, "number_rows", lambda df, *a: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *a))
    rows = spark.createDataFrame([(k, f, 10) for k in range(3) for f in range(4)], "key long, fp long, n long")
    assert similar._numbered(rows).count() == 12
    assert seen and "Join" not in seen[0]


def test_copies_that_stay_apart_meet_by_what_they_changed(spark, monkeypatch):
    from gridlark.llm import similar

    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for changed in [3] * 100 + [1, 2, 5, 7] * 3:  # an index of 0.66 between most of them
        words = list(base)
        for at in rng.sample(range(150), changed):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [t.replace(" w", " y", 1) for t in texts[:6]]
    calls, real = [], similar._alike
    monkeypatch.setattr(similar, "_alike", lambda pairs, sketches: calls.append(pairs.count()) or real(pairs, sketches))
    monkeypatch.setattr(similar, "_simhash_roots", lambda *a: None)
    rows = [(k, t) for k, t in enumerate(texts) if k not in (100, 104, 108)]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_groups(rows)
    assert len(calls) > 1 and sum(calls[1:]) < 10 * len(rows), calls
