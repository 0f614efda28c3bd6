"""A Merkle manifest of a data set: one digest per row, per group and for the whole.

The rows of each group are leaves in order. While a group has several nodes, every run of
`arity` consecutive ones becomes the digest of their digests. Each level is an equi join:
a node asks for the computed numbers of its siblings (its own number moved to the other
slots of its run) and the row in slot zero emits the parent. The groups' tops form a last
tree in the order of the groups, whose top is the root. Proofs are handed down afterwards,
from the root to the leaves, one join on the parent's number per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.columns import crc32_sql, free_name, numbered
from gridlark.llm.registry import query, table
from gridlark.session import cut_lineage

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left:binary,right:binary>"


def leaf_digest(*values: Column) -> Column:
    """Digest of the values: `-` for null, else UTF-8 byte count, `:` and the value."""

    def coded(v: Column) -> Column:
        v = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    return F.sha2(F.concat(*map(coded, values)), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _around(nodes: DataFrame, arity: int) -> DataFrame:
    """The nodes of groups with several, each with the digests left and right in its run."""
    live = nodes.where("_n > 1")
    base = F.col("_at") - F.col("_at") % arity
    slots = F.filter(F.sequence(base, F.least(base + arity, "_n") - 1), lambda s: s != F.col("_at"))
    asked = live.select("_g", "_at", F.explode(slots).alias("_s"))
    given = live.select("_g", F.col("_at").alias("_s"), "_digest")
    heard = asked.join(given, ["_g", "_s"]).groupBy("_g", "_at").agg(F.sort_array(F.collect_list(F.struct("_s", "_digest"))).alias("_heard"))

    def side(keep) -> Column:
        parts = F.filter(F.coalesce("_heard", F.array().cast("array<struct<_s:bigint,_digest:binary>>")), lambda h: keep(h["_s"]))
        return F.aggregate(parts, F.lit(b""), lambda all_, h: F.concat(all_, h["_digest"]))

    both = live.join(heard, ["_g", "_at"], "left")
    return both.select(*live.columns, side(lambda s: s < F.col("_at")).alias("_left"), side(lambda s: s > F.col("_at")).alias("_right"))


def _climb(nodes: DataFrame, most: int, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """By level: nodes with their siblings, and the nodes that are their group's top."""
    levels, tops = [], []
    while True:
        tops.append(nodes.where("_n = 1"))
        if most <= 1:
            return levels, tops
        level = cut_lineage(_around(nodes, arity))
        levels.append(level)
        run = F.sha2(_hex(F.concat("_left", "_digest", "_right")).cast("binary"), 256)
        up = level.where(F.col("_at") % arity == 0)
        up = up.select("_g", F.floor(F.col("_at") / arity).alias("_at"), F.ceil(F.col("_n") / arity).alias("_n"), F.unhex(run).alias("_digest"))
        nodes, most = cut_lineage(up), -(-most // arity)


def _descend(levels: list[DataFrame], tops: list[DataFrame], given: DataFrame, arity: int) -> DataFrame:
    """The nodes of the lowest level with `_path` and what else `given` holds per group."""
    handed = [c for c in given.columns if c != "_g"]
    below = None
    for k in range(len(tops) - 1, -1, -1):
        here = tops[k].join(given, "_g")
        if k < len(levels):
            step = F.struct(F.col("_left").alias("left"), F.col("_right").alias("right"))
            more = levels[k].withColumn("_up", F.floor(F.col("_at") / arity)).join(below, ["_g", "_up"])
            more = more.withColumn("_path", F.concat(F.array(step), "_path")).drop("_up", "_left", "_right")
            here = here.unionByName(more)
        below = here if k == 0 else cut_lineage(here.select("_g", F.col("_at").alias("_up"), *handed))
    return below


def merkle_proofs(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf", arity: int = ARITY) -> DataFrame:
    """`leaves` with `subroot`, `root` and `path`, the digests beside each leaf's way up.

    `leaf` holds lowercase hex digests. Groups are ordered bytewise with null, which is a
    group like any other, first; leaves by `order`, nulls first, and then by digest, so
    equal rows are leaves each and change nothing by their order. `path` lists per level,
    from the leaf up through its group and the groups, the binary digests joined left and
    right of the node; see `folded` and `proof`. A group with one leaf has that as its
    top. No rows give no rows. Other columns stay, under any name; names that would clash
    with `subroot`, `root` or `path` raise.

    Leaves are numbered by a range sort, whatever the groups' sizes; a level's joins are
    on group and number, which are unique, so one group may hold all rows.
    """
    clash = {"subroot", "root", "path"} & {c.lower() for c in leaves.columns}
    if clash or arity < 2:
        raise ValueError(f"columns {sorted(clash)} are taken" if clash else "a run has two nodes or more")
    kept = leaves.columns
    coded = leaves.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"),
        *[F.col(f"`{c}`").alias(f"_o{k}") for k, c in enumerate(order)],
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("_g"),
        F.unhex(F.col(f"`{leaf}`")).alias("_digest"),
    )
    rows = numbered(coded, ["_g"], [f"_o{k}" for k in range(len(order))] + ["_digest"], "_at", "_n")
    nodes = cut_lineage(rows.select("_row", "_g", "_at", "_n", "_digest"))
    most = nodes.agg(F.max("_n")).first()[0] or 0
    levels, tops = _climb(nodes, most, arity)

    narrow = [t.select("_g", "_digest") for t in tops]
    heads = narrow[0]
    for t in narrow[1:]:
        heads = heads.union(t)
    heads = numbered(heads, [], ["_g"], "_at", "_n").select(F.col("_g").alias("_of"), F.lit("").alias("_g"), "_at", "_n", "_digest")
    heads = cut_lineage(heads)
    upper, peaks = _climb(heads, heads.count(), arity)
    peak = peaks[-1].select("_g", F.col("_digest").alias("_root"), F.array().cast(f"array<{_STEP}>").alias("_path"))
    given = _descend(upper, [p.where("false") for p in peaks[:-1]] + peaks[-1:], peak, arity)
    given = cut_lineage(given.select(F.col("_of").alias("_g"), F.col("_digest").alias("_subroot"), "_root", "_path"))
    out = _descend(levels, tops, given, arity)
    return out.select("_row.*", _hex(F.col("_subroot")).alias("subroot"), _hex(F.col("_root")).alias("root"), F.col("_path").alias("path"))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(_hex(p["left"]), _hex(p["right"]))), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda at, p: F.sha2(F.concat(_hex(p["left"]), at, _hex(p["right"])).cast("binary"), 256))


def _sql(levels: int = 7, upper: int = 2) -> str:
    """Fixed numbers of levels: groups of up to 8 ** 7 leaves, 64 groups."""
    coded = "||".join(f"coalesce(strlen(CAST({c} AS VARCHAR))||':'||CAST({c} AS VARCHAR), '-')" for c in FIELDS)
    lower = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    tampered = coded.replace("CAST(text AS VARCHAR)", lower)
    parts = [
        f"""a AS (SELECT doc_id, lang, sha256({coded}) AS leaf, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({tampered})
  ELSE sha256({coded}) END AS claimed FROM documents)""",
        "b0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS said, claimed AS fold FROM a)",
        "n0 AS (SELECT lang, i, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM b0)",
    ]

    def level(n: str, b: str, k: int, key: str, same: str) -> None:
        parts.append(
            f"""r{n}{k} AS (SELECT {key}, i // 8 AS up, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {n}{k} GROUP BY {key}, i // 8)"""
        )
        parts.append(
            f"""{n}{k + 1} AS (SELECT {key}, up AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM r{n}{k})"""
        )
        left, right = "array_to_string(hs[1:b.i % 8], '')", "array_to_string(hs[b.i % 8 + 2:], '')"
        parts.append(
            f"""{b}{k + 1} AS (SELECT b.* EXCLUDE (i, said, fold), b.i // 8 AS i, said || CASE WHEN n > 1 THEN {left} || {right} ELSE '' END AS said,
  CASE WHEN n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold FROM {b}{k} b JOIN r{n}{k} r ON {same} AND r.up = b.i // 8)"""
        )

    for k in range(levels):
        level("n", "b", k, "lang", "r.lang IS NOT DISTINCT FROM b.lang")
    parts.append(f"m0 AS (SELECT 0 AS z, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM n{levels})")
    parts.append(f"c0 AS (SELECT b.* EXCLUDE (i), m0.i, m0.h AS subroot, 0 AS z FROM b{levels} b JOIN m0 ON m0.lang IS NOT DISTINCT FROM b.lang)")
    for k in range(upper):
        level("m", "c", k, "z", "true")
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, subroot, h AS root, sha256(said) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM c{upper}, m{upper}"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query("op12_merkle_manifest", _sql())
def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = leaf_digest(*{**fields, "text": F.translate("text", _UPPER, _UPPER.lower())}.values())
    leaf = leaf_digest(*fields.values())
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(touched, changed).alias("claimed"))
    proofs = merkle_proofs(leaves, "lang", ["doc_id"])
    out = proofs.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("path")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
