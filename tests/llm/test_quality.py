"""The cascade: statistics and verdicts against a plain walk, order and odd rows."""

from collections import Counter

from pyspark.sql import functions as F

from gridlark.llm.columns import BREAK_CHARS
from gridlark.llm.quality import RULES, cascade_order, quality_cascade

SCHEMA = "doc_id long, text string, kept string"


def plain_stats(text):
    text = text or ""
    split = lambda t: [w for w in "".join(" " if c in BREAK_CHARS else c for c in t).split(" ") if w]
    w = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if seen[g] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def plain_kept(text):
    n, chars, symbols, lines, dup, repeat = plain_stats(text)
    bad = n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or 10 * dup > 4 * lines or chars < 2 * n or chars > 40 * n
    return not bad


TEXTS = [
    None, "", " \n\x0b\t ", "one", "a b c", "a b c a b c", "x " * 60, " ".join(f"w{i}" for i in range(80)),
    "line one here\n" * 30 + " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}#" for i in range(80)), " ".join("abcdefgh"[i % 8] for i in range(90)),
    "é😀  x y z " * 40, "\n\n \nsame\nsame\n \n", " ".join(f"{i:050d}" for i in range(55)), " ".join(f"w{i}" for i in range(100_000)),
]


def test_statistics_and_verdicts(spark):
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(TEXTS)] + [(None, TEXTS[7], "mine"), (7, TEXTS[7], "mine")], SCHEMA)
    out = quality_cascade(docs, with_stats=True).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"))
        assert got == plain_stats(r["text"]) and r["_kept"] == plain_kept(r["text"]) and r["kept"] == "mine"
        assert (r["rejected_by"] is None) == r["_kept"] and r["base_failed"] == (got[0] < 50 or 2 * got[5] > got[0])


def test_order_never_changes_the_verdict(spark):
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(TEXTS)], SCHEMA)
    verdicts = []
    for rules in (RULES, RULES[::-1]):
        for rows in (2000, 3):
            out = quality_cascade(docs, rules=rules, sample_rows=rows)
            verdicts.append({r["doc_id"]: r["_kept"] for r in out.collect()})
    assert all(v == verdicts[0] for v in verdicts) and sorted(verdicts[0]) == list(range(len(TEXTS)))


def test_cheap_and_frequent_rejections_come_first(spark):
    junk = [(i, " ".join(f"w{j}##" for j in range(60)), "") for i in range(50)]
    few = [(i, "too few", "") for i in range(3)]
    names = [r.name for r in cascade_order(spark.createDataFrame(junk + few, SCHEMA))]
    assert names[0] == "symbols" and names.index("few_words") < names.index("repeated_words")
    assert [r.name for r in cascade_order(spark.createDataFrame([], SCHEMA))] == [r.name for r in RULES]
    assert quality_cascade(spark.createDataFrame([], SCHEMA)).where(F.col("_kept")).count() == 0
