"""Exact removal of long repeated byte strings, with a logarithmic family of suffix arrays.

Only some suffixes need an index entry. In every window of `length` bytes one place is
chosen by content alone, the leftmost least hash of its 32-byte strings, so two equal
windows choose equal places. A run of neighbouring windows that choose the same place is
one entry, and the windows are looked at again only if the suffix at that place begins
like another one.

New batches become sorted arrays of such suffix heads. A batch is merge-scanned against
the levels that exist, which finds the heads seen before; then it becomes the lowest
level, and levels of equal size merge upwards, so there are about log2(batches) levels.
The windows behind repeated heads are compared whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.columns import broadcast_if_small, free_name
from gridlark.llm.registry import query, table
from gridlark.session import cut_lineage, ensure_checkpoint_dir

LENGTH = 400
BATCHES = 4
HEAD = 32
#: Entries of one head that are compared in one task; heads with more take the other way.
CROWD = 256
_BLOCK = 1 << 22  # bytes of a text that are looked at together
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each of the ``len(data) - length + 1`` strings of `length` bytes."""
    n = len(data)
    if n < length:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    h = (sums[length:] - sums[:-length]) * _powers(_INVERSE, n - length + 1)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if width > n else values


def entries(data: np.ndarray, length: int = LENGTH, head: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of one text: heads, and the first and last window start of each.

    A head orders by its first three bytes and then by a hash of its 32.
    """
    n = len(data) - length + 1
    keys, first, place = [], [], []
    for at in range(0, n, _BLOCK):
        part = data[at : min(at + _BLOCK, n) + length - 1]
        hashes = window_hashes(part, head)
        order = np.arange(len(hashes), dtype=np.uint64)
        chosen = (_least(hashes >> np.uint64(24) << np.uint64(24) | order, length - head + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        p = chosen[starts]
        lead = part[p].astype(np.uint64) << np.uint64(16) | part[p + 1].astype(np.uint64) << np.uint64(8) | part[p + 2].astype(np.uint64)
        k = (lead << np.uint64(39) | hashes[p] >> np.uint64(25)).view(np.int64)  # 63 bits: never negative
        p, starts = p + at, starts + at
        if place and place[-1][-1] == p[0]:  # a run goes on from block to block
            k, p, starts = k[1:], p[1:], starts[1:]
        keys.append(k)
        first.append(starts)
        place.append(p)
        if not len(p):
            keys.pop(), first.pop(), place.pop()
    if not keys:
        none = np.empty(0, np.int64)
        return none, none, none
    lo = np.concatenate(first)
    return np.concatenate(keys), lo, np.r_[lo[1:] - 1, n - 1]


def _entry_rows(texts: DataFrame, length: int, batches: int) -> DataFrame:
    """``(h1, h2, key, lo, hi, batch)`` for the texts ``(h1, h2, text)``."""

    def run(stream):
        for batch in stream:
            for i, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                keys, lo, hi = entries(data, length)
                if len(keys):
                    h1, h2 = batch.column("h1")[i].as_py(), batch.column("h2")[i].as_py()
                    same = lambda v: pa.array(np.full(len(keys), v))
                    yield pa.RecordBatch.from_arrays(
                        [same(np.int64(h1)), same(np.int64(h2)), pa.array(keys), pa.array(lo), pa.array(hi), same(np.int32(h1 % batches))],
                        names=["h1", "h2", "key", "lo", "hi", "batch"],
                    )

    def packed(stream):  # one Arrow batch per input batch, not per text
        for batch in stream:
            made = list(run([batch]))
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]

    return texts.mapInArrow(packed, "h1 bigint, h2 bigint, key bigint, lo bigint, hi bigint, batch int")


class SuffixIndex:
    """Sorted arrays ``(key, n)`` of suffix heads in levels of doubling size."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.levels: dict[int, str] = {}

    def _store(self, rows: DataFrame) -> str:
        path = f"{self.folder}/array-{uuid.uuid4().hex}"
        rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
        return path

    def add(self, heads: DataFrame) -> DataFrame:
        """Take in a batch; gives its repeated heads, counted over all that came before."""
        read = self.spark.read.parquet
        array = self._store(heads.groupBy("key").agg(F.count("*").alias("n")))
        scan = read(array).withColumn("new", F.lit(True))
        for path in self.levels.values():
            scan = scan.union(read(path).withColumn("new", F.lit(False)))
        seen = scan.groupBy("key").agg(F.sum("n").alias("n"), F.max("new").alias("new")).where("new AND n > 1").select("key", "n")
        found = f"{self.folder}/found-{uuid.uuid4().hex}"
        seen.write.parquet(found)
        level = 0
        while level in self.levels:
            both = read(array).union(read(self.levels.pop(level)))
            array = self._store(both.groupBy("key").agg(F.sum("n").alias("n")))
            level += 1
        self.levels[level] = array
        return read(found)


def _pieces(batch, length: int) -> Iterator[tuple[int, int, np.ndarray, bool, list]]:
    """Of each text: its hashes, bytes, whether it has copies, and its repeated entries."""
    for i, text in enumerate(batch.column("text")):
        data = np.frombuffer(text.as_buffer(), np.uint8)
        yield batch.column("h1")[i].as_py(), batch.column("h2")[i].as_py(), data, batch.column("copies")[i].as_py() > 1, batch.column("entries")[i].values


def _cold_rows(alive: DataFrame, length: int) -> DataFrame:
    """The bytes behind entries whose head is shared by few."""

    def run(stream):
        for batch in stream:
            cols: list[list] = [[], [], [], [], [], []]
            for h1, h2, data, copied, found in _pieces(batch, length):
                hot = found.field("hot").to_numpy(zero_copy_only=False)
                for k, lo, hi in zip(*(found.field(c).to_numpy()[~hot].tolist() for c in ("key", "lo", "hi"))):
                    for c, v in zip(cols, (k, h1, h2, lo, copied, data[lo : hi + length].tobytes())):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "h1", "h2", "lo", "copied", "part"])

    return alive.mapInArrow(run, "key bigint, h1 bigint, h2 bigint, lo bigint, copied boolean, part binary")


def _repeated(digests: np.ndarray, copied: np.ndarray) -> np.ndarray:
    """Where a digest occurs twice or belongs to a text with copies."""
    order = np.argsort(digests, kind="stable")
    d = digests[order]
    starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    weight = np.add.reduceat(1 + copied[order].astype(np.int64), starts) if len(d) else starts
    out = np.empty(len(d), bool)
    out[order] = np.repeat(weight > 1, np.diff(np.r_[starts, len(d)]))
    return out


def _runs(hit: np.ndarray, owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that are hit, as runs: owner, first byte and the byte after the last."""
    at = np.flatnonzero(hit)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none
    new = np.r_[True, (owner[at][1:] != owner[at][:-1]) | (start[at][1:] != start[at][:-1] + 1)]
    a = np.flatnonzero(new)
    z = np.r_[a[1:] - 1, len(at) - 1]
    return owner[at][a], start[at][a], start[at][z] + length


def _compare(t: pa.Table, length: int) -> pa.RecordBatch | None:
    """Spans of repeated windows among parts; all parts of a head are there."""
    parts = t.column("part").to_pylist()
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    all_digests = window_hashes(data, length)
    n = sizes - length + 1
    owner = np.repeat(np.arange(len(parts)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    digests = all_digests[np.repeat(np.cumsum(sizes) - sizes, n) + inside]
    keys, lo = t.column("key").to_numpy(), t.column("lo").to_numpy()
    copied = t.column("copied").to_numpy()
    mixed = digests ^ (keys.astype(np.uint64) * _MIX)[owner]
    who, a, z = _runs(_repeated(mixed, copied[owner]), owner, lo[owner] + inside, length)
    if not len(who):
        return None
    return pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[who]) for c in ("h1", "h2")] + [pa.array(a), pa.array(z)], names=["h1", "h2", "a", "z"])


def _cold_spans(rows: DataFrame, length: int) -> DataFrame:
    def run(stream):
        held, size = [], 0
        for batch in stream:
            held.append(batch)
            size += batch.nbytes
            if size < _BLOCK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last head may go on
            # whole heads, a bounded number of bytes at a time
            ends = np.flatnonzero(np.r_[keys[1:cut] != keys[: cut - 1], True]) + 1 if cut else []
            weight = np.cumsum([len(p) for p in t.column("part").slice(0, cut).to_pylist()]) if cut else []
            start = 0
            for e in ends:
                if weight[e - 1] - (weight[start - 1] if start else 0) >= _BLOCK or e == cut:
                    if (out := _compare(t.slice(start, e - start), length)) is not None:
                        yield out
                    start = e
            held = t.slice(cut).to_batches()
            size = sum(b.nbytes for b in held) if cut else 0
        if held:
            t = pa.Table.from_batches(held)
            if t.num_rows and (out := _compare(t, length)) is not None:
                yield out

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "h1 bigint, h2 bigint, a bigint, z bigint")


def _hot_spans(alive: DataFrame, length: int, ranges: int) -> DataFrame:
    """Spans behind heads shared by many: window digests, sorted and merged by range.

    A task packs the digests of its windows by range; each range is looked through on its
    own, and the places of repeated windows go back to where they came from. No row or
    task depends on how many entries share a head.
    """

    def pack(stream):
        task, slice_no = TaskContext.get().partitionId(), 0
        digests, copies, starts, h1s, h2s, counts, held = [], [], [], [], [], [], 0

        def flush():
            nonlocal slice_no
            d = np.concatenate(digests)
            c = np.repeat(np.array(copies, bool), counts)
            at = (d >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(ranges + 1, dtype=np.uint64))
            index = (order.astype(np.uint32) << np.uint32(1)) | c[order].astype(np.uint32)
            name = (task << 32) + slice_no
            blobs = [d[order[a:z]].tobytes() + index[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:])]
            meta = np.array([h1s, h2s, starts, counts], np.int64).tobytes()
            rows = [(name, r, b) for r, b in enumerate(blobs) if b] + [(name, -1, meta)]
            slice_no += 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["slice", "range", "blob"])

        for batch in stream:
            for h1, h2, data, copied, found in _pieces(batch, length):
                hot = found.field("hot").to_numpy(zero_copy_only=False)
                for k, lo, hi in zip(*(found.field(c).to_numpy()[hot].tolist() for c in ("key", "lo", "hi"))):
                    for a in range(lo, hi + 1, _BLOCK):
                        z = min(hi + 1, a + _BLOCK)
                        digests.append(window_hashes(data[a : z + length - 1], length))
                        for column, v in zip((copies, starts, h1s, h2s, counts), (copied, a, h1, h2, z - a)):
                            column.append(v)
                        held += z - a
                    if held >= 1 << 20:
                        yield flush()
                        for column in (digests, copies, starts, h1s, h2s, counts):
                            column.clear()
                        held = 0
        if held:
            yield flush()

    packed = cut_lineage(alive.mapInArrow(pack, "slice bigint, range int, blob binary"))

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        n = [len(b) // 12 for b in pdf["blob"]]
        digests = np.concatenate([np.frombuffer(b, np.uint64, c) for b, c in zip(pdf["blob"], n)])
        index = np.concatenate([np.frombuffer(b, np.uint32, c, 8 * c) for b, c in zip(pdf["blob"], n)])
        hit = _repeated(digests, (index & 1).astype(bool))
        ends = np.cumsum(n)
        out = [(index[e - c : e][hit[e - c : e]] >> 1).astype(np.uint32).tobytes() for e, c in zip(ends, n)]
        return pd.DataFrame({"slice": pdf["slice"], "range": 0, "blob": out}).loc[[bool(b) for b in out]]

    found = packed.where("range >= 0").groupBy("range").applyInPandas(look, "slice bigint, range int, blob binary")

    def spans(pdf: pd.DataFrame) -> pd.DataFrame:
        meta = pdf["range"] < 0
        h1, h2, starts, counts = np.frombuffer(pdf["blob"][meta].iloc[0], np.int64).reshape(4, -1)
        total = int(counts.sum())
        hit = np.zeros(total, bool)
        for b in pdf["blob"][~meta]:
            hit[np.frombuffer(b, np.uint32)] = True
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        who, a, z = _runs(hit, owner, starts[owner] + inside, length)
        return pd.DataFrame({"h1": h1[who], "h2": h2[who], "a": a, "z": z})

    back = found.union(packed.where("range < 0"))
    return back.groupBy("slice").applyInPandas(spans, "h1 bigint, h2 bigint, a bigint, z bigint")


def repeated_spans(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, crowd: int = CROWD) -> DataFrame:
    """Texts with repeats, once each: ``(h1, h2, text, spans)``, spans of bytes to remove.

    `docs` has h1, h2 (two hashes that stand for the text) and text. Copies of a text
    share their spans, so they collapse to one row with a count before bytes are moved.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/suffixes-{uuid.uuid4().hex}"
    long = docs.where(F.octet_length("text") >= length)
    _entry_rows(long, length, batches).write.parquet(f"{folder}/entries", partitionBy="batch")
    stored = spark.read.schema("h1 bigint, h2 bigint, key bigint, lo bigint, hi bigint, batch int").parquet(f"{folder}/entries")
    index, found = SuffixIndex(spark, folder), None
    for b in range(batches):
        new = index.add(stored.where(F.col("batch") == b).select("key"))
        found = new if found is None else found.union(new)
    # the last count of a head covers all batches
    heads = found.groupBy("key").agg(F.max("n").alias("n"))
    heads.write.parquet(f"{folder}/heads")
    heads = spark.read.parquet(f"{folder}/heads")
    crowded = heads.where(F.col("n") > crowd).agg(F.sum("n")).first()[0] or 0

    live = stored.drop("batch").join(broadcast_if_small(heads), "key").withColumn("hot", F.col("n") > crowd)
    live = live.groupBy("h1", "h2").agg(F.collect_set(F.struct("key", "lo", "hi", "hot")).alias("entries"))
    texts = long.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts.join(live, ["h1", "h2"]).write.option("compression", "zstd").parquet(f"{folder}/alive")
    alive = spark.read.parquet(f"{folder}/alive")
    spans = _cold_spans(_cold_rows(alive, length), length)
    if crowded:
        spans = spans.union(_hot_spans(alive, length, max(64, crowded * length // (1 << 23))))
    spans = spans.groupBy("h1", "h2").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    return alive.select("h1", "h2", "text").join(spans, ["h1", "h2"])


def _merged(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    new = np.r_[True, a[1:] > z[:-1]]
    return a[new], z[np.r_[new[1:], True]]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), body.alias("text"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, batches: int = BATCHES, crowd: int = CROWD) -> DataFrame:
    """Texts that lose bytes: ``(h1, h2, n_removed, n_spans, kept)``, one row per text.

    Every byte is removed that lies in a string of `length` bytes which also starts
    anywhere else, in the same or another text; strings are judged on the input. A text
    is known by `text_keys`. Null and short texts lose nothing by themselves. Copies count
    as other texts, so all but the shortest texts with copies are removed whole. `kept`
    is binary, as a cut may split a character.

    The index holds a few bytes per entry, about one entry per 180 bytes. Texts are moved
    once, the bytes behind repeated heads once more; what is compared together is bounded
    by `crowd` entries or by ranges of digests. Windows are equal if 63 bits of their
    heads and 64 bits of their digests agree.
    """

    def cut(stream):
        for batch in stream:
            out = []
            for i, body in enumerate(batch.column("text")):
                data = np.frombuffer(body.as_buffer(), np.uint8)
                found = batch.column("spans")[i].values
                a, z = _merged(found.field("a").to_numpy(), found.field("z").to_numpy())
                keep = np.ones(len(data), bool)
                for s, e in zip(a, z):
                    keep[s:e] = False
                out.append((int((~keep).sum()), len(a), data[keep].tobytes()))
            columns = list(zip(*out)) or [(), (), ()]
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), *made], names=["h1", "h2", "n_removed", "n_spans", "kept"])

    marked = repeated_spans(_keyed(docs, text), length, batches, crowd)
    return marked.mapInArrow(cut, "h1 bigint, h2 bigint, n_removed bigint, n_spans bigint, kept binary")


def text_keys(text: str = "text"):
    """The two hashes by which results of `remove_repeats` are joined to rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(body), F.xxhash64(F.lit(1), body)


def without_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with `text` replaced by what `remove_repeats` leaves, and `n_removed`.

    All rows, copies and other columns stay. Bytes of a character that was cut through
    are replaced by U+FFFD. `n_removed` gets a leading underscore if `docs` has it.
    """
    lost = remove_repeats(docs, text, **options)
    h1, h2, n, body = (free_name(docs, c) for c in ("h1", "h2", "n_removed", "kept"))
    lost = lost.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("n_removed").alias(n), F.make_valid_utf8(F.col("kept").cast("string")).alias(body))
    keys = text_keys(text)
    joined = docs.withColumn(h1, keys[0]).withColumn(h2, keys[1]).join(lost, [h1, h2], "left")
    columns = [F.coalesce(body, text).alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.col(n), F.lit(0)).alias(n))


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lost = remove_repeats(docs).select("h1", "h2", "n_removed", "n_spans", F.sha2("kept", 256).alias("rest"))
    h1, h2 = text_keys()
    body = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), F.octet_length(body).cast("bigint").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("whole"))
    return facts.join(lost, ["h1", "h2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("rest", "whole").alias("kept_sha256"),
        (F.col("n_bytes") - F.coalesce("n_removed", F.lit(0))).alias("kept_bytes"),
        (F.coalesce("n_removed", F.lit(0)) > 0).alias("has_repeats"),
    )
