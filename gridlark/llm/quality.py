"""Quality rules as a short-circuit cascade.

Every rule says when a text is rejected and how much work it takes to find out. A
sample tells how often each rule rejects and what it costs; the rules are then tried in
the order of most rejections per cost among the texts that the earlier ones leave. The
order changes the work, never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.columns import BREAK_CHARS, free_name, let, n_words, words
from gridlark.llm.registry import query, table

SYMBOLS = "#*$%&|<>"


def word_chars(text: Column) -> Column:
    """Code points inside words."""
    return F.char_length(F.translate(text, BREAK_CHARS, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint")


def _word_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.translate(line, BREAK_CHARS, "") != "")


def n_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.size(_word_lines(text)).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(_word_lines(text), lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("bigint"))


def n_repeat_words(text: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more."""

    def windows(h: Column) -> Column:
        # one hash per window, from the hashes of its words
        return F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    def covered(starts: Column) -> Column:
        # windows that start less than three words apart share words
        walk = F.aggregate(
            starts,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("at")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["at"])).alias("n"), p.alias("at")),
        )
        return walk["n"]

    def repeated(s: Column) -> Column:
        same = lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

    def count(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        found = covered(let(ordered, repeated))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(found)

    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) < 4, F.lit(0).cast("bigint")).otherwise(let(windows(h), count)))


#: What the rules look at, by name.
STATS: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}
#: Work per character of text to find a statistic; only their ratios matter.
WORK = {"n_words": 3.0, "word_chars": 1.0, "n_symbols": 1.0, "n_lines": 2.0, "n_dup_lines": 3.0, "n_repeat_words": 12.0}


@dataclass(frozen=True)
class Rule:
    """`rejects` takes the named statistics as columns and is true for a bad text."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]
    base: bool = False

    def work(self) -> float:
        return sum(WORK[n] for n in self.needs)


RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50, base=True),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n, base=True),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 4 * n),
    Rule("short_words", ("word_chars", "n_words"), lambda c, n: c < 2 * n),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: c > 40 * n),
)


def _test(rule: Rule, stat: Callable[[str], Column]) -> Column:
    return F.coalesce(rule.rejects(*[stat(n) for n in rule.needs]), F.lit(False))


def cascade_order(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 2000, seed: int = 7) -> list[Rule]:
    """The rules by rejections per cost, from a sample of about `sample_rows` texts.

    The sample only decides the order. What comes back from it is at most one row per
    set of rules that reject together. An empty table leaves the given order.
    """
    n = docs.count()
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    if n > sample_rows:
        sample = sample.sample(fraction=sample_rows / n, seed=seed)
    bits = [_test(r, lambda s: STATS[s](F.col("t"))).alias(f"r{i}") for i, r in enumerate(rules)]
    flags = sample.select(F.char_length("t").alias("size"), *bits)
    seen = flags.groupBy(*[f"r{i}" for i in range(len(rules))]).agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    order, left = [], list(range(len(rules)))
    while left:

        def gain(i: int) -> float:
            size = sum(row["size"] + row["n"] for row in seen)
            return sum(row["n"] for row in seen if row[f"r{i}"]) / (rules[i].work() * size) if size else 0.0

        best = max(left, key=lambda i: (gain(i), -rules[i].work(), -i)) if seen else left[0]
        order.append(rules[best])
        left.remove(best)
        seen = [row for row in seen if not row[f"r{best}"]]
    return order


def quality_cascade(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 2000, with_stats: bool = False
) -> DataFrame:
    """Add `kept` and `rejected_by`, the first rule of the cascade that rejects the text.

    With `with_stats` all statistics and `base_failed` are added too, which leaves
    nothing to skip; otherwise a statistic is only computed where no earlier rule has
    rejected the text. A null text counts as empty; rows are never merged or dropped, so
    repeated rows and null keys stay as they are. New names that clash with columns of
    `docs` get a leading underscore. The texts are read in one pass without a shuffle.
    """
    order = cascade_order(docs, text, rules, sample_rows)
    body = F.coalesce(F.col(text), F.lit(""))
    names = {n: free_name(docs, n) for n in (*STATS, "base_failed", "rejected_by", "kept")}
    if with_stats:
        docs = docs.withColumns({names[n]: f(body) for n, f in STATS.items()})
    stat = (lambda n: F.col(names[n])) if with_stats else (lambda n: STATS[n](body))
    reason = F.lit(None).cast("string")
    for rule in reversed(order):
        reason = F.when(_test(rule, stat), F.lit(rule.name)).otherwise(reason)
    out = docs.withColumn(names["rejected_by"], reason)
    if with_stats:
        failed = F.lit(False)
        for rule in rules:
            if rule.base:
                failed = failed | _test(rule, stat)
        out = out.withColumn(names["base_failed"], failed)
    return out.withColumn(names["kept"], F.col(names["rejected_by"]).isNull())


#: The statistics of `documents` in DuckDB, as common table expressions ending in `stats`.
STATS_SQL = """
d0 AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
d1 AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM d0),
grams AS (SELECT rid, i, {'a': w[i], 'b': w[i + 1], 'c': w[i + 2]} AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d1 WHERE len(w) > 2)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
hit AS (SELECT rid, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT rid, i + o AS p FROM again, (VALUES (0), (1), (2)) v(o)) GROUP BY rid),
stats AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ln) AS BIGINT) AS n_lines, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d1 LEFT JOIN hit USING (rid)),
verdict AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 40 * n_words) AS kept FROM stats)
"""


@query(
    "op9_quality_rules",
    f"WITH {STATS_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict",
)
def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_cascade(docs, with_stats=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
