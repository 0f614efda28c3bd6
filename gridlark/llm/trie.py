"""The prefix trie of conversations: who shares which opening turns, and what that saves.

Equal conversations collapse first. The distinct turn sequences are sorted by range, and
every shard of that order grows a ternary search tree over the ids that its own dictionary
gives the turns, middle sequence first so that the trees stay balanced. Walking the nodes
back in the order in which they were made adds up members, leaves and savings. Only
openings that two neighbouring shards share are split between them; these boundary nodes
are merged afterwards by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridlark.llm.columns import broadcast_if_small, crc32_sql
from gridlark.llm.registry import query, table
from gridlark.operators.ordered import number_rows
from gridlark.session import cut_lineage

CODE = 24  # bytes per turn in a sequence: 16 of its digest, 8 for the size of its text
TURNS_AT_ONCE = 2_000_000  # of one tree
IDS_AT_ONCE = 65536
DEEP = 64  # boundary nodes hand sums up through so many depths in one round
NOBODY = hashlib.sha256(b"").hexdigest()


class Tree:
    """A ternary search tree of turn sequences; node 0 is the root, which has no turn."""

    def __init__(self):
        self.code, self.low, self.same, self.high, self.up = [-1], [-1], [-1], [-1], [-1]

    def add(self, codes: list[int]) -> int:
        """The node of a sequence, made if it is new."""
        code, low, same, high = self.code, self.low, self.same, self.high
        at = 0
        for c in codes:
            links, last, node = same, at, same[at]
            while node >= 0 and code[node] != c:
                links, last = (low if c < code[node] else high), node
                node = links[node]
            if node < 0:
                node = len(code)
                links[last] = node
                for column, value in ((code, c), (low, -1), (same, -1), (high, -1), (self.up, at)):
                    column.append(value)
            at = node
        return at


def middle_first(n: int) -> Iterator[int]:
    """0 to n - 1 so that each number halves what is left around it."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(mid + 1, hi), (lo, mid)]


def _codes(sequence: bytes) -> list[bytes]:
    return [sequence[at : at + CODE] for at in range(0, len(sequence), CODE)]


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns of the common opening of two sequences."""
    lo, hi = 0, min(len(a), len(b)) // CODE
    while lo < hi:  # the longest equal prefix, by halves
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: mid * CODE] == b[: mid * CODE] else (lo, mid - 1)
    return lo


def _openings(sequence: bytes, turns: int) -> list[bytes]:
    """Digests of the first 0 to `turns` turns."""
    out, running = [], hashlib.blake2b(digest_size=16)
    out.append(running.copy().digest())
    for code in _codes(sequence[: turns * CODE]):
        running.update(code)
        out.append(running.copy().digest())
    return out


def shard_nodes(rows: list[tuple], before: int, after: int) -> tuple[list[tuple], list[tuple]]:
    """The nodes of sorted distinct sequences ``(sequence, n, conv_id, ends)``.

    `before` and `after` count the turns that the first and last sequence share with the
    neighbouring shards. Returns the inner nodes, which are whole, and the boundary nodes,
    whose sums leave out themselves and other boundary nodes.
    """
    split = [_codes(r[0]) for r in rows]
    words = sorted({c for codes in split for c in codes})
    number = {w: k for k, w in enumerate(words)}
    weight = [int.from_bytes(w[16:], "big") for w in words]
    coded = [[number[c] for c in codes] for codes in split]
    tree = Tree()
    where = [0] * len(rows)
    for k in middle_first(len(rows)):
        where[k] = tree.add(coded[k])
    size = len(tree.code)
    n, children, leaves, saved, depth = [0] * size, [0] * size, [0] * size, [0] * size, [0] * size
    conv: list[int | None] = [None] * size
    ends = [NOBODY] * size
    for at, (_, members, least, digest) in zip(where, rows):
        n[at], conv[at], ends[at] = members, least, digest
    edge: dict[int, tuple[bytes, list[bytes]]] = {}
    for sequence, codes, shared in ((rows[0][0], coded[0], before), (rows[-1][0], coded[-1], after)):
        names = _openings(sequence, shared)
        for d in range(shared + 1):
            edge[tree.add(codes[:d])] = (names[d], names[d // DEEP * DEEP - (DEEP if d % DEEP == 0 else 0) : d] if d else [])
    for i in range(1, size):
        depth[i] = depth[tree.up[i]] + 1
    for i in range(size - 1, -1, -1):
        up = tree.up[i]
        if i not in edge:
            leaves[i] += children[i] == 0
            saved[i] += (n[i] - 1) * weight[tree.code[i]]
            children[up] += 1
            leaves[up] += leaves[i]
            saved[up] += saved[i]
        if up >= 0:
            n[up] += n[i]
            conv[up] = conv[i] if conv[up] is None else min(conv[up], conv[i])
    inner, outer = [], []
    for i in range(size):
        up = tree.up[i]
        sums = (depth[i], conv[i], n[i], children[i], leaves[i], saved[i], ends[i])
        if i in edge:
            name, above = edge[i]
            outer.append((*sums, weight[tree.code[i]] if i else 0, name, above, None))
        else:
            inner.append((*sums, None, edge[up][0] if up in edge else None, None, None if up in edge else conv[up]))
    return inner, outer


_NODE = (
    "shard bigint, edge boolean, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "ends_sha256 string, weight bigint, name binary, above array<binary>, parent_conv_id bigint"
)
_KINDS = [pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int64()]


def _member_digests(members: DataFrame) -> DataFrame:
    """``(key, ends)``: SHA-256 of each key's ids in ascending order, joined by commas.

    Sorting and formatting are spread by range, whatever the size of a key; only the
    digest itself, which has to read its bytes in order, passes through one task as a
    stream of text blocks.
    """

    def blocks(batches):
        key, ids = None, []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "said"])

        for b in batches:
            for k, i in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
                if ids and (k != key or len(ids) >= IDS_AT_ONCE):
                    yield block()
                    ids = []
                key = k
                ids.append(i)
        if ids:
            yield block()

    def digests(batches):
        key, running = None, None
        for b in batches:
            done = []
            for k, said in zip(b.column("key").to_pylist(), b.column("said").to_pylist()):
                if running is not None and k == key:
                    running.update(b",")
                else:
                    if running is not None:
                        done.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256()
                running.update(said.encode())
            yield _two(done)
        if running is not None:
            yield _two([(key, running.hexdigest())])

    def _two(done):
        keys, said = zip(*done) if done else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(said, pa.string())], names=["key", "ends"])

    ranged = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = ranged.mapInArrow(blocks, "key binary, first bigint, said string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends string")


def turn_sequences(turns: DataFrame, convs: DataFrame, order: list[str]) -> DataFrame:
    """``(conv_id, sequence)`` for every row of `convs`: the codes of its turns in order.

    A code holds 16 bytes of the turn's digest and the UTF-8 bytes of its text, so equal
    turns have equal codes without a table of turns.
    """
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    code = F.concat(F.unhex(F.substring(said, 1, 32)), F.unhex(F.lpad(F.hex(F.octet_length("text").cast("bigint")), 16, "0")))
    placed = turns.select("conv_id", F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], code.alias("code")).alias("t"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t"))["code"].alias("codes"))
    joined = convs.join(whole, "conv_id", "left")
    return joined.select("conv_id", F.coalesce(F.unhex(F.array_join(F.transform("codes", F.hex), "")), F.lit(b"")).alias("sequence"))


def prefix_trie(conversations: DataFrame, shards: int | None = None, at_once: int = TURNS_AT_ONCE) -> DataFrame:
    """One row per node of the trie of ``(conv_id, sequence)``; ids are distinct.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. An empty sequence ends at the root. No rows give
    no nodes. A shard's tree holds about `at_once` turns; longer shards are cut into
    several trees, which is a shard border like any other. A conversation is one row of
    24 bytes a turn, so its length is bounded by what a row may hold, not by a parameter.
    """
    members = cut_lineage(conversations.select("conv_id", "sequence", F.unhex(F.substring(F.sha2("sequence", 256), 1, 32)).alias("key")))
    ends = _member_digests(members.select("key", "conv_id"))
    distinct = members.groupBy("sequence", "key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    distinct = distinct.join(ends, "key").select("sequence", "n", "conv_id", "ends")
    distinct = cut_lineage(distinct)
    ranged = distinct.repartitionByRange(shards, "sequence") if shards else distinct.repartitionByRange("sequence")
    shard = cut_lineage(ranged.sortWithinPartitions("sequence").withColumn("shard", F.spark_partition_id().cast("bigint")))

    # what neighbouring shards share: one row per task of the sort
    line = W.orderBy("shard")
    borders = shard.groupBy("shard").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"))
    borders = borders.select("shard", "first", "last", F.lag("last").over(line).alias("left"), F.lead("first").over(line).alias("right"))

    def lengths(batches):
        for b in batches:
            row = {c: b.column(c).to_pylist() for c in b.schema.names}
            shared = [[shared_turns(x or b"", y or b"") for x, y in zip(row[p], row[q])] for p, q in (("left", "first"), ("last", "right"))]
            yield pa.RecordBatch.from_arrays([b.column("shard"), *[pa.array(s, pa.int64()) for s in shared]], names=["shard", "before", "after"])

    borders = borders.mapInArrow(lengths, "shard bigint, before bigint, after bigint")
    fed = shard.join(F.broadcast(borders), "shard")

    def grown(batches):
        part, held, before, made = [], 0, None, 0

        def flush(until):
            nonlocal made
            inner, outer = shard_nodes(part, before, until)
            number = (task << 24) + made
            made += 1
            for rows, edge in ((inner, False), (outer, True)):
                for at in range(0, len(rows), 4096):
                    cut = rows[at : at + 4096]
                    columns = [[number] * len(cut), [edge] * len(cut), *zip(*cut)]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS)], names=[f.split()[0] for f in _NODE.split(", ")])

        for b in batches:
            for task, sequence, n, conv, digest, first, last in zip(*(b.column(c).to_pylist() for c in ("shard", "sequence", "n", "conv_id", "ends", "before", "after"))):
                before = first if before is None else before
                if part and held + len(sequence) // CODE > at_once:
                    shared = shared_turns(part[-1][0], sequence)
                    yield from flush(shared)
                    part, held, before = [], 0, shared
                part.append((sequence, n, conv, digest))
                held += len(sequence) // CODE + 1
        if part:
            yield from flush(last)

    nodes = cut_lineage(fed.mapInArrow(grown, _NODE))
    inner, outer = nodes.where("not edge"), nodes.where("edge")
    merged = outer.groupBy("name").agg(
        *[F.first(c).alias(c) for c in ("depth", "weight", "above")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min("conv_id").alias("conv_id"),
        F.min(F.when(F.col("ends_sha256") != NOBODY, F.col("ends_sha256"))).alias("ends"),
    )
    parent = F.element_at("above", -1)
    merged = cut_lineage(merged.withColumn("parent", F.when(F.col("depth") > 0, parent)))
    kin = merged.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("kin"))
    own = merged.join(broadcast_if_small(cut_lineage(kin)), "name", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kin", F.lit(0)))
    own = own.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("weight"))
    own = cut_lineage(own.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))).drop("kin"))

    # sums go up within DEEP depths at once, the deepest stretch first
    deepest = own.agg(F.max("depth")).first()[0] or 0
    stretch = F.floor((F.col("depth") - 1) / DEEP)
    for k in range((deepest - 1) // DEEP, -1, -1) if deepest else ():
        gifts = own.where(stretch == k).select(F.explode("above").alias("name"), "n_leaves", "saved_tokens")
        gifts = gifts.groupBy("name").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        more = own.join(gifts, "name", "left")
        own = cut_lineage(
            more.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("s", F.lit(0))}).drop("l", "s")
        )
    names = broadcast_if_small(cut_lineage(own.select("name", F.col("conv_id").alias("parent_conv_id"))))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    outer_rows = own.withColumn("ends_sha256", F.coalesce("ends", F.lit(NOBODY))).join(names.withColumnRenamed("name", "parent"), "parent", "left")
    # a boundary node with many children has them in many shards: names go by shard first
    by_shard = broadcast_if_small(cut_lineage(outer.select("shard", "name").join(names, "name")))
    hung = inner.where("name is not null").drop("parent_conv_id").join(by_shard, ["shard", "name"])
    return outer_rows.select(columns).unionByName(hung.select(columns)).unionByName(inner.where("name is null").select(columns))


def shared_openings(conversations: DataFrame) -> DataFrame:
    """``(conv_id, sequence)`` of all conversations with openings shared in fives.

    Conversation c takes the first h turns of conversation c - c % 5, where h is
    ``crc32(decimal c) % 9``, and then its own turns after its first h. Null roles and
    texts are empty; turns follow turn (null first), role and text, so repeated rows have
    a fixed order. Rows without a conv_id belong to no conversation. `%` has the sign of
    c. Other columns are left behind.
    """
    t = conversations.where("conv_id is not null")
    t = t.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = cut_lineage(number_rows(t, ["conv_id"], ["turn", "role", "text"], "no"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h")
    convs = t.select("conv_id").distinct().select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    convs = cut_lineage(convs)
    opening = t.where("no <= 8").withColumnRenamed("conv_id", "base").join(convs, "base").where("no <= h").select("conv_id", "no", "role", "text")
    own = t.withColumn("h", h).where("no > h").select("conv_id", "no", "role", "text")
    return turn_sequences(opening.union(own), convs.select("conv_id"), ["no"])


_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, no, role, text FROM c JOIN t ON t.conv_id = c.base AND no <= h UNION ALL
  SELECT c.conv_id, no, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND no > h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY no) AS d, strlen(text) AS w, sha256(strlen(role) || ':' || role || text) AS s FROM r),
p AS (SELECT conv_id, d, w, sha256(string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM q
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT node, any_value(up) AS up, d, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS e FROM m GROUP BY node, d),
k AS (SELECT up AS node, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
b AS (SELECT DISTINCT above.node AS top, below.node FROM m above JOIN m below ON below.conv_id = above.conv_id AND below.d >= above.d),
s AS (SELECT top AS node, sum((n - 1) * w) AS saved, count(*) FILTER (kids IS NULL) AS leaves FROM b JOIN n USING (node) LEFT JOIN k USING (node) GROUP BY top)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children,
  leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.e AS ends_sha256 FROM n LEFT JOIN k USING (node) JOIN s USING (node) LEFT JOIN n parent ON parent.node = n.up"""


@query("op13_conversation_trie", _SQL)
def op13_conversation_trie(spark, sf_dir):
    return prefix_trie(shared_openings(table(spark, sf_dir, "conversations")))
