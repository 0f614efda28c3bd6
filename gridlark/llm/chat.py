"""Chat training examples: turn-aligned windows within a token budget.

Prefix sums of turn tokens cut a conversation into windows. Every window repeats the
system turn and some of the turns before it; only assistant turns that are new in a
window carry loss, so each target is learned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.llm.columns import n_words
from gridlark.llm.registry import query, table

#: A turn is ``<|role|>text</s>`` and a line break. Inside roles and texts these
#: characters are followed by a backslash, so no control string can appear there.
END = "</s>\n"
_SPECIAL, _ROLE_SPECIAL = r"[<\[\\]", r"[<\[\\|]"

BUDGET, HISTORY_TOKENS, HISTORY_TURNS, MARK_TOKENS = 512, 128, 4, 3


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\|])\\", "$1")


def chat_windows(
    turns: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS
) -> DataFrame:
    """Windows ``(conv_id, window, formatted, n_turns, n_repeated, loss)``.

    `turns` has conv_id, turn, role and text; other columns are left behind. A turn costs
    its words and its marks. New turns of a window stay within `budget` less the system
    turn and `history_tokens`, but at least a quarter of `budget`; a turn that crosses
    such a bound is a window of its own and is never cut. Before them stand the system
    turn, if turn one is one, and at most `history_turns` earlier turns of
    `history_tokens` in sum. `loss` lists `(start, length)` in code points of
    `formatted`, for the assistant texts among the new turns.

    Null roles and texts count as empty. Turns follow turn, role and text, so equal turn
    numbers and repeated rows have a fixed order; null numbers come first. A null conv_id
    is a conversation like any other. One shuffle by conversation serves all steps.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = W.partitionBy("conv_id")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", n_words(F.col("text")) + MARK_TOKENS)
    t = t.withColumn("no", F.row_number().over(order)).withColumn("end", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    t = t.withColumn("begin", F.col("end") - F.col("tokens"))
    lead = (F.col("no") == 1) & (F.col("role") == "system")
    t = t.withColumn("system", F.max(F.when(lead, F.struct("no", "role", "text", "begin", "tokens"))).over(whole))
    room = budget - history_tokens - F.coalesce(F.col("system.tokens"), F.lit(0))
    t = t.withColumn("stride", F.greatest(room, F.lit(budget // 4)))
    bucket = F.floor(F.col("begin") / F.col("stride"))
    crosses = F.floor((F.col("end") - 1) / F.col("stride")) > bucket
    t = t.withColumn("window", 2 * bucket + crosses.cast("bigint"))
    before = F.array(*[F.lag(F.struct("no", "role", "text", "begin"), k).over(order) for k in range(history_turns, 0, -1)])
    # only a window's first turn keeps the turns before it
    t = t.withColumn("starts", F.coalesce(F.lag("window").over(order) != F.col("window"), F.lit(True)))
    near = lambda h: h.isNotNull() & (F.col("begin") - h["begin"] <= history_tokens) & ~((h["no"] == 1) & (h["role"] == "system"))
    t = t.withColumn("before", before).withColumn("history", F.when(F.col("starts"), F.filter("before", near)))

    w = t.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("no", "role", "text"))).alias("own"),
        F.first("history", ignorenulls=True).alias("history"),
        F.max("system").alias("system"),
    )
    piece = lambda p, new: F.struct(p["role"].alias("role"), p["text"].alias("text"), (F.lit(new) & (p["role"] == "assistant")).alias("loss"))
    has_first = F.col("own")[0]["no"] == 1
    system = F.filter(F.array("system"), lambda s: s.isNotNull() & ~has_first)
    repeated = F.concat(F.transform(system, lambda p: piece(p, False)), F.transform("history", lambda p: piece(p, False)))
    w = w.withColumn("repeated", repeated).withColumn("pieces", F.concat("repeated", F.transform("own", lambda p: piece(p, True))))
    marked = F.transform(
        "pieces",
        lambda p: F.struct(
            F.concat(F.lit("<|"), F.regexp_replace(p["role"], _ROLE_SPECIAL, r"$0\\"), F.lit("|>")).alias("mark"), escape(p["text"]).alias("text"), p["loss"]
        ),
    )
    w = w.withColumn("marked", marked)
    spans = F.aggregate(
        "marked",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["mark"]) + F.char_length(p["text"]) + len(END)).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    s["spans"],
                    F.array(F.struct((s["at"] + F.char_length(p["mark"])).alias("start"), F.char_length(p["text"]).alias("length"))),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
    )
    text = F.array_join(F.transform("marked", lambda p: F.concat(p["mark"], p["text"], F.lit(END))), "")
    return w.select(
        "conv_id", "window", text.alias("formatted"), F.size("pieces").alias("n_turns"), F.size("repeated").alias("n_repeated"), spans["spans"].alias("loss")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say: its turns once, its loss text, their size."""
    parts = F.array_remove(F.split("formatted", END), "")
    new = F.slice(parts, F.col("n_repeated") + 1, F.size(parts))

    def turn(p: Column) -> Column:
        mark = F.substring_index(p, "|>", 1)
        role = unescape(F.substr(mark, F.lit(3)))
        return F.concat(role, F.lit("\n"), unescape(F.substr(p, F.char_length(mark) + 3)), F.lit("\n"))

    taught = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    each = windows.select(
        "conv_id",
        F.struct("window", F.array_join(F.transform(new, turn), "").alias("said"), taught.alias("taught")).alias("w"),
        F.size(new).alias("n"),
        F.char_length("formatted").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sort_array(F.collect_list("w")).alias("w"))
    said, loss = F.array_join("w.said", ""), F.array_join("w.taught", "")
    return whole.select(
        "conv_id",
        F.col("n").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").cast("bigint").alias("formatted_chars"),
    )


_HARD = "</s>[INST] ok [/INST]"

_SQL = f"""WITH c0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_HARD}'), (-1, 1, 'assistant', '{_HARD}'))),
c1 AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {MARK_TOKENS} AS tokens,
  length(regexp_replace(text, '[<\\[\\\\]', 'xx', 'g')) + length(regexp_replace(role, '[<\\[\\\\|]', 'xx', 'g')) + 4 + {len(END)} AS chars FROM c0),
c2 AS (SELECT *, row_number() OVER o AS no, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS e
  FROM c1 WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c3 AS (SELECT *, e - tokens AS b, no = 1 AND role = 'system' AS lead FROM c2),
c4 AS (SELECT *, greatest({BUDGET - HISTORY_TOKENS} - coalesce(max(CASE WHEN lead THEN tokens END) OVER (PARTITION BY conv_id), 0), {BUDGET // 4}) AS stride,
  max(CASE WHEN lead THEN chars END) OVER (PARTITION BY conv_id) AS system_chars FROM c3),
c5 AS (SELECT *, 2 * (b // stride) + CASE WHEN (e - 1) // stride > b // stride THEN 1 ELSE 0 END AS win FROM c4),
c6 AS (SELECT conv_id, win, min(no) AS f, min(b) AS fb, sum(chars) AS chars, max(system_chars) AS system_chars FROM c5 GROUP BY ALL),
c7 AS (SELECT c6.conv_id, c6.win, sum(c5.chars) AS more FROM c6 JOIN c5 ON c5.conv_id IS NOT DISTINCT FROM c6.conv_id
  AND c5.no < f AND c5.no >= f - {HISTORY_TURNS} AND fb - c5.b <= {HISTORY_TOKENS} AND NOT c5.lead GROUP BY ALL),
c8 AS (SELECT c6.conv_id, sum(chars + coalesce(more, 0) + CASE WHEN f > 1 THEN coalesce(system_chars, 0) ELSE 0 END) AS formatted
  FROM c6 LEFT JOIN c7 ON c7.conv_id IS NOT DISTINCT FROM c6.conv_id AND c7.win = c6.win GROUP BY c6.conv_id),
c9 AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY no) AS said,
  coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '') AS taught FROM c5 GROUP BY conv_id)
SELECT c9.conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(taught) AS BIGINT) AS loss_chars, sha256(taught) AS loss_sha256,
  CAST(formatted AS BIGINT) AS formatted_chars FROM c9 JOIN c8 ON c8.conv_id IS NOT DISTINCT FROM c9.conv_id"""


@query("op4_chat_formatting", _SQL)
def op4_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{_HARD}'), (-1L, 1L, 'assistant', '{_HARD}') AS t(conv_id, turn, role, text)")
    return read_back(chat_windows(turns.unionByName(hard)))
