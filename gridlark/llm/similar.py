"""Near copies by exact similarity of word shingle sets, found with SimHash and min-hash bands.

The similarity of two texts is the Jaccard index of their sets of five-word shingles. Sets
whose SimHash fingerprints are equal or linked at 3 bits meet first, are verified shingle by
shingle, and what they link is contracted. At an index of 0.8 about ten of 64 bits differ,
so what the fingerprints leave apart meets on keys: 128 least values under different orders
agree in the share of the index; four of them make a key, so two sets at 0.8 share one of
32 keys but for 5 in 100 million, and closer sets meet more surely. They are verified alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.columns import broadcast_if_small
from gridlark.llm.simhash import _hashes, least_of_each, linked_fingerprints, majority_bits
from gridlark.operators.connected import connected
from gridlark.operators.ordered import number_rows
from gridlark.session import drop_table, stored_table

SHINGLE = 5
LEAST = 0.8
_ORDERS, _BANDS = 128, 32
_AGREE = 78  # of 128; sets at 0.8 stay below in fewer than one of a million cases
_TOGETHER = 4096  # sets of a key that one task compares with its first ones
_WEIGHTS = 18  # steps of weight in a set's size
_BESIDE = 1_000_000  # hashes of templates that are broadcast together

_rng = np.random.default_rng(64)
_MULT = _rng.integers(0, 1 << 63, _ORDERS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, _ORDERS, np.uint64)
_BAND = _rng.integers(0, 1 << 63, _BANDS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the shingles; a text of fewer words is one shingle."""
    parts = [np.unique(h) for h in _hashes(text, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _least_values(hashes: np.ndarray) -> np.ndarray:
    least = np.full(_ORDERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024]
        least = np.minimum(least, (part * _MULT[:, None] + _PLUS[:, None]).min(axis=1))
    return least


def _keys(least: np.ndarray) -> np.ndarray:
    keys = _BAND.copy()
    for column in least.reshape(_BANDS, -1).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def set_marks(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, fp, n, sim, sketch, keys)`` of every row: digest, size and SimHash
    of the shingle set, a byte of each least value, and its keys (none without words).
    """

    def run(batches):
        # short slices: a batch of long texts is not held as Python strings
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            fp, size, sim, sketch, keys = [], [], [], [], []
            for t in b.column("text").to_pylist():
                hashes = shingle_set(t, shingle)
                fp.append(xxhash.xxh64_intdigest(hashes.tobytes(), 7))
                size.append(len(hashes))
                sim.append(majority_bits([hashes]))
                least = _least_values(hashes)
                sketch.append(least.astype(np.uint8).tobytes())
                keys.append(_keys(least) if len(hashes) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("text_hash"),
                    pa.array(np.array(fp, np.uint64).view(np.int64)),
                    pa.array(size, pa.int64()),
                    pa.array(np.array(sim, np.uint64).view(np.int64)),
                    pa.array(sketch, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "fp", "n", "sim", "sketch", "keys"],
            )

    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash bigint, fp bigint, n bigint, sim bigint, sketch binary, keys array<bigint>")


def _simhash_pairs(marks: DataFrame) -> DataFrame:
    """Stored pairs ``(a, b)`` of sets: the least set of a fingerprint with the others that
    have it and with the least sets of the fingerprints linked to it.
    """
    sets = marks.where("n > 0").select("sim", "fp")
    firsts = stored_table(sets.groupBy("sim").agg(F.min("fp").alias("first"), F.count("*").alias("sets")))
    ends = _beside(firsts.select("sim", "first"))
    links = linked_fingerprints(firsts.select(F.col("sim").alias("fp")))
    across = links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = _beside(firsts.where("sets > 1").select("sim", "first"))
    within = sets.join(several, "sim").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    pairs = stored_table(across.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    drop_table(firsts)
    return pairs


def _simhash_roots(docs: DataFrame, marks: DataFrame, shingle: int, least: float) -> DataFrame | None:
    """``(fp, root)`` of the sets that meet by fingerprint and have an index of at least `least`."""
    pairs = _simhash_pairs(marks)
    if pairs.isEmpty():
        return None
    sets = _sets(docs, marks, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), shingle)
    roots = _contracted(None, _verified(sets, pairs, least))
    for table in (sets, pairs):
        drop_table(table)
    return roots


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sketches agree often enough to be verified."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, _ORDERS) for c in ("x", "y"))
            near = (x == y).sum(axis=1) >= _AGREE
            yield batch.select(["a", "b"]).filter(pa.array(near))

    both = pairs.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")
    return both.mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, shown: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Stored ``(fp, hashes)`` of the wanted sets, read again from one text each."""

    def run(batches):
        for b in batches:
            for part in (b.slice(at, 256) for at in range(0, b.num_rows, 256)):
                sets = [shingle_set(t, shingle).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("fp"), pa.array(sets, pa.binary())], names=["fp", "hashes"])

    wanted = stored_table(shown.select("fp", "text_hash").join(wanted, "fp", "left_semi"))
    texts = docs.select("text").join(broadcast_if_small(wanted), F.xxhash64("text") == F.col("text_hash")).select("fp", "text")
    return stored_table(texts.mapInArrow(run, "fp bigint, hashes binary").dropDuplicates(["fp"]))


def _verified(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The stored pairs whose sets have a Jaccard index of at least `least`."""

    def judged(batches):
        for b in batches:
            near = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                shared = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                near.append(shared / ((len(x) + len(y)) // 8 - shared) >= least)
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return stored_table(both.mapInArrow(judged, "a bigint, b bigint"))


def _clusters(named: DataFrame) -> DataFrame:
    """Stored ``(fp, cluster)``: the sets that keys ``(key, fp)`` of several sets connect."""
    firsts = stored_table(named.groupBy("key").agg(F.min("fp").alias("a")))
    return stored_table(connected(named.join(_beside(firsts), "key").select("a", F.col("fp").alias("b"))).toDF("fp", "cluster"))


def _differences(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Stored ``(cluster, fp, n, d, diff)``: how each set differs from the template of its
    cluster, the hashes that more than half of the cluster's sets have.
    """

    def spread(batches):
        for b in batches:
            for fp, raw in zip(b.column("fp").to_pylist(), b.column("hashes").to_pylist()):
                h = pa.array(np.frombuffer(raw, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), fp)), h], names=["fp", "h"])

    def differ(batches):
        for b in batches:
            sizes, out = [], []
            for raw, most in zip(b.column("hashes").to_pylist(), b.column("template")):
                own = np.frombuffer(raw, np.int64)
                sizes.append(len(own))
                out.append(np.setxor1d(own, most.values.to_numpy(), assume_unique=True) if most.is_valid else own)
            made = [pa.array(sizes, pa.int64()), pa.array([len(o) for o in out], pa.int64()), pa.array(out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("cluster"), b.column("fp"), *made], names=["cluster", "fp", "n", "d", "diff"])

    rows = sets.mapInArrow(spread, "fp bigint, h bigint").join(_beside(clusters), "fp")
    members = _beside(stored_table(clusters.groupBy("cluster").agg(F.count("*").alias("members"))))
    most = rows.groupBy("cluster", "h").agg(F.count("*").alias("c")).join(members, "cluster").where("2 * c > members")
    templates = stored_table(most.groupBy("cluster").agg(F.collect_list("h").alias("template")))
    hashes = templates.agg(F.sum(F.size("template"))).first()[0] or 0
    beside = F.broadcast(templates) if hashes <= _BESIDE else templates
    each = sets.join(_beside(clusters), "fp").join(beside, "cluster", "left").select("cluster", "fp", "hashes", "template")
    return stored_table(each.mapInArrow(differ, "cluster bigint, fp bigint, n bigint, d bigint, diff array<bigint>"))


def _surely_near(diffs: DataFrame, least: float) -> DataFrame:
    """Stored pairs ``(a, b)`` of a cluster's set of the least weight with all that it must be linked to."""
    weighed = diffs.select("cluster", "fp", (F.col("d") - F.col("n") * ((1 - least) / (1 + least))).alias("w"))
    first = weighed.groupBy("cluster").agg(F.min(F.struct("w", "fp")).alias("m")).select("cluster", F.col("m.w").alias("low"), F.col("m.fp").alias("hub"))
    near = weighed.join(_beside(stored_table(first)), "cluster").where("fp <> hub AND w + low <= 1e-6")
    return stored_table(near.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")))


def _first_keys(diffs: DataFrame, least: float) -> DataFrame:
    """``(key, fp, n, side)``: two sets of a cluster with an index of at least `least` surely share
    a key, unless they differ from the template in so little that `_surely_near` links both.

    Two sets differ from each other where their differences from the template do. Let
    the weight of a set of n hashes be what it differs in, less n (1 - least) / (1 + least).
    Then sets with the index share at least half the sum of both weights of their
    differences. The hashes of a difference are ordered by how few of the cluster have
    them; two sets that share enough share one among the first of both, and how many that
    are follows from both weights. So a key is a hash and the steps of both sizes and
    weights, and a set has one for every step that its partner may have. Where the steps of
    both differ, `side` (1 or 2, else 0) tells whose the set is, and only unlike sides meet. What a
    template has in common is in no difference, so copies that stay apart meet by what both changed.
    """
    ratio, width = (1 - least) / (1 + least), float(np.log(1 / LEAST))

    def keys(batches):
        for b in batches:
            out, owner, sizes, sides = [], [], [], []
            for cluster, fp, n, d, line in zip(*(b.column(c).to_pylist() for c in ("cluster", "fp", "n", "d")), b.column("line")):
                h = line.values.field("h").to_numpy().view(np.uint64) ^ np.uint64(cluster * int(_MIX) % (1 << 64))
                alone = d - len(h)  # hashes that no other set of the cluster has come first
                own, weight = int(np.floor(np.log(n) / width)), d - ratio * n
                for other in (own - 1, own, own + 1):
                    step = float(np.exp(min(own, other) * width)) / _WEIGHTS
                    mine, reach = int(np.floor(weight / step)), int(np.ceil(2 * ratio * n / least / step)) + 1
                    for its in range(mine - reach, mine + reach + 1):
                        shared = max(1, int(np.ceil((weight + its * step) / 2 - 1e-6)))
                        if (first := d - shared + 1 - alone) > 0:
                            ends = sorted([(own, mine), (other, its)])
                            k = h[:first]
                            for part in (*ends[0], *ends[1]):
                                k = (k ^ np.uint64(part % (1 << 64))) * _MIX
                                k ^= k >> np.uint64(29)
                            out.append(k)
                            owner += [fp] * len(k)
                            sizes += [n] * len(k)
                            sides += [0 if ends[0] == ends[1] else 1 + ends.index((own, mine))] * len(k)
            made = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            columns = [pa.array(made), pa.array(owner, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sides, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "n", "side"])

    rows = stored_table(diffs.select("cluster", "fp", "n", "d", F.explode("diff").alias("h")))
    often = stored_table(rows.groupBy("cluster", "h").agg(F.count("*").alias("c")).where("c > 1"))
    ranked = rows.join(broadcast_if_small(often), ["cluster", "h"])
    lines = ranked.groupBy("cluster", "fp", "n", "d").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("line"))
    return lines.mapInArrow(keys, "key bigint, fp bigint, n bigint, side int").distinct()


def _numbered(rows: DataFrame) -> DataFrame | None:
    """The sets ``(key, fp, n, side, size, at, root)`` of keys where several meet; None if there are none."""
    rows = rows if "side" in rows.columns else rows.withColumn("side", F.lit(0))
    sides = [F.min("side").alias("lo"), F.max("side").alias("hi")]
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), *sides).where("size > 1 AND (lo = 0 OR lo < hi)")
    shared = stored_table(shared.select("key", "size"))
    n_rows, biggest = shared.agg(F.sum("size"), F.max("size")).first()
    if not n_rows:
        return None
    rows = stored_table(rows.join(shared, "key"))
    met = stored_table(rows.groupBy("fp").agg(F.sum("size").alias("met")))
    # numbering passes over its rows several times where a key is large
    ranked = stored_table(rows.join(met, "fp").withColumn("order", -F.col("met")))
    named = number_rows(ranked, ["key"], ["order", "fp"], "at", max(1000, n_rows // 256), biggest)
    return stored_table(named.select("key", "fp", "n", "side", "size", "at").withColumn("root", F.col("fp")))


def _still_apart(named: DataFrame, roots: DataFrame | None, last: int) -> DataFrame:
    """What is left to compare: rows after `last` of keys that hold several components."""
    left = named.where(F.col("at") > last)
    if roots is not None:
        left = left.drop("root").join(_beside(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp")).select(*named.columns)
    fresh = stored_table(left)
    apart = fresh.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    kept = stored_table(fresh.join(apart, "key", "left_semi"))
    drop_table(fresh)
    drop_table(named)
    return kept


def _near(named: DataFrame, last: int, sketches: DataFrame, least: float) -> DataFrame:
    """Stored pairs of different components: the sets up to `last` of each key with all that follow."""
    salts = F.ceil(F.col("size") / _TOGETHER).cast("int")
    a = named.where(F.col("at") <= last).select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("at").alias("pa"), F.col("fp").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("side").alias("sa"))
    b = named.select("key", (F.col("at") % salts).cast("int").alias("salt"), F.col("at").alias("pb"), F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("side").alias("sb"))
    close = F.least("na", "nb") / F.greatest("na", "nb") >= least
    met = (F.col("sa") == 0) | (F.col("sa") != F.col("sb"))
    pairs = a.join(b, ["key", "salt"]).where((F.col("pa") < F.col("pb")) & (F.col("ra") != F.col("rb")) & close & met)
    pairs = stored_table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    near = stored_table(_alike(pairs, sketches))
    drop_table(pairs)
    return near


def set_roots(docs: DataFrame, marks: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``(fp, root)`` of the sets that are linked: the components of all pairs that meet by
    fingerprint or share a key and have a Jaccard index of at least `least`; root is the
    least set.

    Sets that meet by fingerprint are linked first, and keys that then hold one component
    are left out. The sets of a key are numbered by how many others they meet over all their keys, so
    that the text of which the others are copies comes first. The first eight of a key are
    compared with all that follow, and the links are contracted. Most keys then hold one
    component or nothing more to compare. The sets of the others, which share much but
    stay apart, are told by what they changed of the template they share and get the keys of
    `_first_keys`; there the same goes on in rounds, eight times
    as many first sets in each, with the components contracted after every round, until
    no key holds several. Nothing is capped, and sets that have a passage or a template
    in common meet once at most.
    """
    if not LEAST <= least <= 1:
        raise ValueError("the keys are made for an index of 0.8 or more")
    none = marks.sparkSession.createDataFrame([], "fp bigint, root bigint")
    roots = _simhash_roots(docs, marks, shingle, least)
    named = _numbered(marks.select(F.explode("keys").alias("key"), "fp", "n"))
    if named is not None and roots is not None:
        named = _still_apart(named, roots, 0)
    if named is None or named.isEmpty():
        return none if roots is None else roots
    shown = stored_table(marks.join(named.select("fp").distinct(), "fp", "left_semi").select("fp", "text_hash", "sketch"))
    sketches = shown.select("fp", "sketch")
    near = _near(named, 8, sketches, least)
    if not near.isEmpty():
        sets = _sets(docs, shown, near.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), shingle)
        roots = _contracted(roots, _verified(sets, near, least))
        drop_table(sets)
    drop_table(near)
    named = _still_apart(named, roots, 8)
    if named.isEmpty():
        return none if roots is None else roots
    sets = _sets(docs, shown, named.select("fp").distinct(), shingle)
    diffs = _differences(sets, _clusters(named))
    drop_table(named)
    near = _surely_near(diffs, least)
    if not near.isEmpty():
        roots = _contracted(roots, _verified(sets, near, least))
    drop_table(near)
    named, last, width = _numbered(_first_keys(diffs, least)), 0, 8
    if named is not None and roots is not None:
        named = _still_apart(named, roots, 0)
    while named is not None and not named.isEmpty():
        last += width
        width *= 8
        near = _near(named, last, sketches, least)
        if not near.isEmpty():
            roots = _contracted(roots, _verified(sets, near, least))
        drop_table(near)
        named = _still_apart(named, roots, last)
    return none if roots is None else roots


def _beside(stored: DataFrame) -> DataFrame:
    return broadcast_if_small(stored)


def _contracted(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(fp, root)`` after more links between sets, by components of the roots they join."""
    if roots is None:
        return stored_table(connected(links).toDF("fp", "root"))
    ends = _beside(roots)
    up = links.join(ends.toDF("a", "ra"), "a", "left").join(ends.toDF("b", "rb"), "b", "left")
    moved = stored_table(connected(up.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).toDF("root", "top"))
    joined = roots.union(moved.join(ends, moved["root"] == ends["fp"], "left_anti").select(F.col("root").alias("fp"), F.col("root")))
    after = joined.join(_beside(moved), "root", "left").select("fp", F.coalesce("top", "root").alias("root"))
    after = stored_table(after)
    for table in (roots, moved):
        drop_table(table)
    return after


def near_groups(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id)`` for every row of `docs`.

    The component is the smallest doc_id reachable over texts with a similarity of at
    least `least`; texts with the same shingles collapse before anything is compared.
    Nulls, ids and repeated rows are treated as in `simhash.near_groups`.
    """
    marks = stored_table(set_marks(docs, shingle))
    # fingerprint, keys and sketch are a function of the set, whichever row shows it
    shown = F.min(F.struct("text_hash", "n", "sim", "sketch", "keys")).alias("one")
    distinct = stored_table(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), shown).select("fp", "least", "one.*"))
    roots = stored_table(set_roots(docs, distinct, shingle, least))
    named = distinct.select("fp", "least").join(_beside(roots), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored_table(named)
    names = stored_table(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = named.join(names, "root").select("fp", "component_id")
    return marks.select("doc_id", "text_hash", "fp").join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each_similar(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay: of every group of similar texts the smallest doc_id."""
    return least_of_each(docs, near_groups(docs, **options))
