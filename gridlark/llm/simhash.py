"""SimHash near-duplicates found by fuzzy keys from the binary Golay code.

A fingerprint is cut into three segments of at most 23 bits. Every 23-bit word lies
within 3 bits of exactly one codeword of the perfect Golay code, and two words that
differ in one bit have this in common: the codeword nearest to either lies within 4 bits
of the other. So a segment's keys are its nearest codeword and, where that is 3 bits
away, the five codewords 4 bits away. Of 3 differing bits at most one segment can hold
two or more, so some pair of segments differs by a bit each at most, and a key made of
both segments' codewords meets. Pairs that meet are verified bit by bit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.columns import broadcast_if_small
from gridlark.llm.registry import query, table
from gridlark.operators.connected import connected
from gridlark.session import cut_lineage

MOST_BITS = 3
SHINGLE = 3
DENSE = 8192  # fingerprints of a bucket that are compared in one task
_WORDS_AT_ONCE = 100_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Unsigned XXH64 values, seed 42, of the shingles of a text, a block at a time."""
    low = (text or "").encode().lower()
    words = (m.group() for m in _WORD.finditer(low)) if len(low) > 4_000_000 else iter(low.split())
    kept: list[bytes] = []
    whole = False
    while block := list(islice(words, _WORDS_AT_ONCE)):
        run = kept + block
        if len(run) >= shingle:
            whole = True
            joined = map(b" ".join, zip(*(run[k:] for k in range(shingle))))
            yield np.array([xxhash.xxh64_intdigest(s, 42) for s in joined], np.uint64)
        kept = run[-(shingle - 1) :] if shingle > 1 else []
    if kept and not whole:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), 42)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the hashes; zero for a text without words."""
    return majority_bits(_hashes(text, shingle))


def majority_bits(blocks: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes that come in blocks."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        for part in range(0, len(h), 65536):
            bits = np.unpackbits(h[part : part + 65536].astype("<u8").view(np.uint8), bitorder="little")
            ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(sum(1 << i for i in range(64) if 2 * ones[i] > n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every row; `fp` holds the 64 bits as a signed number."""

    def run(batches):
        for b in batches:
            got = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(got.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash bigint, fp bigint")


#: Generator of the [23, 12, 7] code and the place and width of the segments.
_GENERATOR = 0b101011100011
_SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the high bits; by syndrome, the nearest error and the five of weight 4."""
    rest = np.zeros(4096, np.int64)
    for high in range(4096):
        r = high << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= _GENERATOR << (bit - 11)
        rest[high] = r
    syndrome = lambda x: int(rest[x >> 11] ^ (x & 2047))
    near = np.zeros(2048, np.int64)
    far: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(1, 5):
        for at in combinations(range(23), weight):
            e = sum(1 << i for i in at)
            if weight < 4:
                near[syndrome(e)] = e
            else:
                far[syndrome(e)].append(e)
    five = np.array([f or [-1] * 5 for f in far], np.int64)
    return rest, near, five


_REST, _NEAR, _FIVE = _tables()


def codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 23-bit words: the nearest codeword's index, and all key indices in six columns.

    Unused columns repeat the nearest.
    """
    s = _REST[x >> 11] ^ (x & 2047)
    nearest = (x ^ _NEAR[s]) >> 11
    others = np.where(_FIVE[s] >= 0, (x[:, None] ^ _FIVE[s]) >> 11, nearest[:, None])
    return nearest, np.column_stack([nearest, others])


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the row each belongs to; two fingerprints within 3 bits share one."""
    bits = fps.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in _SEGMENTS]
    coded = [codewords(p) for p in parts]
    keys = []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ni, ki), (nj, kj) = coded[i], coded[j]
        both = np.concatenate([ki << 12 | nj[:, None], ni[:, None] << 12 | kj], axis=1)
        keys.append(pair << 24 | both)
    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    rows = np.nonzero(first)[0]
    return keys[first], rows


def _star(fps: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within one bucket; fingerprints are distinct."""
    rest = fps
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        edge = [root]
        while edge and len(rest):
            near = np.bitwise_count(rest ^ edge.pop()) <= most
            for f in rest[near]:
                yield int(root), int(f)
                edge.append(f)
            rest = rest[~near]


def _linked(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of sorted keys: pairs in small ones, forests in others."""
    fps = fps.view(np.uint64)  # numpy counts the bits of absolute values
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat(sizes <= 8, sizes)
    k, f, a, b = keys[small], fps[small], [], []
    for step in range(1, 8):
        near = (k[step:] == k[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= most)
        a.append(f[step:][near])
        b.append(f[:-step][near])
    for at, n in zip(starts[sizes > 8], sizes[sizes > 8]):
        forest = np.array(list(_star(fps[at : at + n], most)), np.uint64).reshape(-1, 2)
        a.append(forest[:, 0])
        b.append(forest[:, 1])
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def _bucket_links(rows: DataFrame, most: int) -> DataFrame:
    """Links within buckets of at most `DENSE` rows ``(key, fp)``."""

    def run(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if len(keys) and keys[0] != keys[-1]:  # the last bucket may go on
                cut = int(np.searchsorted(keys, keys[-1]))
                a, b = _linked(keys[:cut], fps[:cut], most)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            a, b = _linked(keys, fps, most)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def _ball_links(fps: DataFrame) -> DataFrame:
    """Links among distinct fingerprints of buckets too large to compare pair by pair.

    Two fingerprints within 3 bits have a point within one bit of one and two bits of the
    other. Of all fingerprints within two bits of a point, each is linked to one within a
    bit of it, so where there is such a one they all hang together.
    """
    flips = np.array([0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))], np.uint64).view(np.int64)

    def points(batches):
        for batch in batches:
            f = batch.column("fp").to_numpy()
            for at in range(0, len(f), 256):
                part = f[at : at + 256]
                near = np.tile(np.arange(len(flips)) <= 64, len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part[:, None] ^ flips).ravel()), pa.array(np.repeat(part, len(flips))), pa.array(near)], names=["point", "fp", "near"]
                )

    each = fps.mapInArrow(points, "point bigint, fp bigint, near boolean")
    hubs = each.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.count("*").alias("n")).where("a IS NOT NULL AND n > 1")
    return each.join(hubs, "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def linked_fingerprints(fps: DataFrame, most: int = MOST_BITS, dense: int = DENSE) -> DataFrame:
    """A graph ``(a, b)`` over distinct fingerprints `fp` with the components of all
    pairs that differ in at most `most` (3 or fewer) bits; every link is such a pair or
    joins fingerprints that such pairs connect.
    """
    if not 0 <= most <= MOST_BITS:
        raise ValueError("the keys guarantee 3 bits at most")

    def keyed(batches):
        for batch in batches:
            f = batch.column("fp").to_numpy()
            keys, rows = fuzzy_keys(np.ascontiguousarray(f))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f[rows])], names=["key", "fp"])

    rows = fps.mapInArrow(keyed, "key bigint, fp bigint")
    hot = cut_lineage(rows.groupBy("key").count().where(F.col("count") > dense).select("key"))
    if hot.isEmpty():
        return _bucket_links(rows, most)
    crowded = rows.join(broadcast_if_small(hot), "key", "left_semi").select("fp").distinct()
    links = _ball_links(crowded) if most == MOST_BITS else _exact_balls(crowded, most)
    return links.union(_bucket_links(rows.join(broadcast_if_small(hot), "key", "left_anti"), most))


def _exact_balls(fps: DataFrame, most: int) -> DataFrame:
    """The same for fewer than 3 bits: every fingerprint and all words within `most` bits."""
    flips = [0, *(1 << i for i in range(64))]
    if most == 2:
        flips += [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    flips = np.array(flips if most else [0], np.uint64).view(np.int64)

    def points(batches):
        for batch in batches:
            f = batch.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(f, len(flips))), pa.array((f[:, None] ^ flips).ravel())], names=["a", "b"])

    return fps.mapInArrow(points, "a bigint, b bigint").join(fps.withColumnRenamed("fp", "b"), "b").where("a <> b").select("a", "b")


def name_groups(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``(fp, component_id)`` of all of ``(fp, least)``: the smallest `least` reachable over the links."""
    roots = connected(links).withColumnRenamed("node", "fp")
    roots = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = cut_lineage(roots)
    names = cut_lineage(roots.groupBy("root").agg(F.min("least").alias("component_id")))
    return cut_lineage(roots.join(names, "root").select("fp", "component_id"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS, dense: int = DENSE) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id)`` for every row of `docs`.

    The component is the smallest doc_id reachable over fingerprints that differ in at
    most `most` bits. Equal fingerprints collapse before anything is compared, so a group
    of copies of any size is one row there. Null texts count as empty and share the zero
    fingerprint with all texts without words. Repeated rows stay; null ids take part but
    name a component only if it has no other id (then null).

    Buckets of up to `dense` fingerprints are compared in one task, which gives back a
    forest and never all pairs; larger buckets are resolved by points near each
    fingerprint, which is exact too and bounded per row.
    """
    fps = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = name_groups(distinct, linked_fingerprints(distinct.select("fp"), most, dense))
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay: of every group the document with the smallest doc_id.

    A group without any id keeps all its rows. Rows that repeat id and text are one
    document, of which one row stays; rows that share an id but not the text are judged
    apart. Texts move once, for the join with what stays.
    """
    return least_of_each(docs, near_groups(docs, **options))


def least_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of `docs` that name their group in ``(doc_id, text_hash, component_id)``."""
    groups = groups.where("doc_id <=> component_id")
    stay = cut_lineage(groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")))
    repeats = not stay.where("n > 1").isEmpty()
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    kept = docs.join(stay, same, "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if repeats else kept


@query("op3_simhash_golay")
def op3_simhash_golay(spark, sf_dir):
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
