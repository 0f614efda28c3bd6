"""Fixed-length training rows packed from token ids by best fit decreasing.

Documents longer than a row are split into whole rows and a rest; pieces are placed
longest first into the row with the least room that still holds them, which a segment
tree over capacities finds. A row carries its ids, the cumulative lengths of its
segments, positions that start again with each segment, and where each segment is from.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridlark.llm.bpe import public_vocabulary
from gridlark.llm.registry import query, table

ROW = 2048
AT_ONCE = 16_000_000  # tokens that a task packs together


class Capacities:
    """Open rows by room left: a segment tree of which capacities have any."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = np.zeros(2 * self.size, bool)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.size + room
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and number of a row with the least room of at least `need`."""
        i = self.size + need
        while not self.any[i]:
            while i & 1:  # a right child has nothing beyond it below its parent
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            while i and not (self.any[2 * i] or self.any[2 * i + 1] if i < self.size else False):
                self.any[i] = False
                i >>= 1
        return room, row


def best_fit(sizes: np.ndarray, row: int) -> list[list[int]]:
    """Numbers of the pieces in each row, in the order they were placed."""
    open_rows, out = Capacities(row), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        found = open_rows.take(n)
        if found is None:
            out.append([])
            found = row, len(out) - 1
        room, at = found
        out[at].append(i)
        open_rows.put(room - n, at)
    return out


def _pieces(lengths: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, piece number and size; one empty piece for an empty document."""
    parts = np.maximum(1, -(-lengths // row))
    doc = np.repeat(np.arange(len(lengths)), parts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    return doc, piece, np.minimum(row, lengths[doc] - piece * row)


def pack(coded: DataFrame, row: int = ROW, pad: int = 0, wide: bool = False, key: str = "doc_id", ids: str = "ids", at_once: int = AT_ONCE) -> DataFrame:
    """Rows of `row` ids from documents whose ids are little-endian unsigned 32-bit integers.

    Returns ``(row_id, ids, n_tokens, cu_seqlens, positions, keys, pieces)``. `ids` and
    `positions` hold `row` little-endian unsigned integers of 16 bits, or of 32 if `wide`;
    the end is filled with `pad` and position 0. Segment s covers ``cu_seqlens[s]`` to
    ``cu_seqlens[s + 1]`` and is piece ``pieces[s]`` of document ``keys[s]``: joining a
    document's pieces gives its ids back. Null or empty ids give one empty segment. Repeated
    rows are packed each; other columns are left behind. An id that does not fit raises.

    A task packs what it reads, about `at_once` tokens together, so nothing is shuffled
    and a row that is not full is the exception; every row can be made anew from its input.
    """
    kind = "<u4" if wide else "<u2"
    if not 0 < row <= np.iinfo(kind).max + 1:
        raise ValueError("positions of a row must fit the integer width")
    most = np.iinfo(kind).max

    def packed(docs: list, tokens: list[np.ndarray], first: int) -> pa.RecordBatch:
        doc, piece, sizes = _pieces(np.array([len(t) for t in tokens], np.int64), row)
        columns: list[list] = [[] for _ in range(7)]
        for n, members in enumerate(best_fit(sizes, row)):
            parts = [tokens[doc[i]][piece[i] * row : piece[i] * row + sizes[i]] for i in members]
            body = np.concatenate([*parts, np.full(row - sum(map(len, parts)), pad, np.uint32)])
            if body.max(initial=0) > most:
                raise ValueError(f"an id above {most} needs wide=True")
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            places = np.concatenate([*(np.arange(len(p)) for p in parts), np.zeros(row - ends[-1])])
            values = (first + n, body.astype(kind).tobytes(), int(ends[-1]), ends, places.astype(kind).tobytes(), [docs[doc[i]] for i in members], piece[members])
            for c, v in zip(columns, values):
                c.append(v)
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), None, pa.list_(pa.int32()))
        names = ("row_id", "ids", "n_tokens", "cu_seqlens", "positions", "keys", "pieces")
        return pa.RecordBatch.from_arrays([pa.array(c, t or pa.list_(key_type)) for c, t in zip(columns, kinds)], names=names)

    key_name = dict(coded.dtypes)[key]
    key_type = pa.int64() if key_name in ("bigint", "int", "smallint", "tinyint") else pa.string()
    if key_type == pa.int64():
        key_name = "bigint"
    elif key_name != "string":
        raise ValueError("keys are whole numbers or text")

    def run(stream):
        base, made, docs, tokens, held = TaskContext.get().partitionId() << 32, 0, [], [], 0
        for batch in stream:
            for d, b in zip(batch.column("key").to_pylist(), batch.column("ids")):
                docs.append(d)
                tokens.append(np.frombuffer(b.as_py() or b"", "<u4"))
                held += len(tokens[-1]) + 1
                if held >= at_once:
                    out = packed(docs, tokens, base + made)
                    made += out.num_rows
                    for at in range(0, out.num_rows, 512):
                        yield out.slice(at, 512)
                    docs, tokens, held = [], [], 0
        if docs:
            out = packed(docs, tokens, base + made)
            for at in range(0, out.num_rows, 512):
                yield out.slice(at, 512)

    schema = f"row_id bigint, ids binary, n_tokens int, cu_seqlens array<int>, positions binary, keys array<{key_name}>, pieces array<int>"
    return coded.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids").mapInArrow(run, schema)


def unpack(rows: DataFrame, wide: bool = False, key_name: str = "bigint") -> DataFrame:
    """The segments ``(key, piece, ids)`` of packed rows, ids as in the input of `pack`."""
    kind = "<u4" if wide else "<u2"

    def run(stream):
        for batch in stream:
            keys, pieces, ids = [], [], []
            for b, ends, k, p in zip(*(batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "keys", "pieces"))):
                body = np.frombuffer(b, kind)
                keys += k
                pieces += p
                ids += [body[a:z].astype("<u4").tobytes() for a, z in zip(ends, ends[1:])]
            kind_of = pa.string() if key_name == "string" else pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind_of), pa.array(pieces, pa.int32()), pa.array(ids, pa.binary())], names=["key", "piece", "ids"])

    return rows.select("ids", "cu_seqlens", "keys", "pieces").mapInArrow(run, f"key {key_name}, piece int, ids binary")


def library_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``(doc_id, ids)`` by the tokenizer library itself; null texts give no ids."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    made: list[Callable] = []

    def run(stream):
        if not made:
            ranks, pattern = shared.value
            made.append(tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
        for batch in stream:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [np.array(made[0](t or ""), "<u4").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


@query("op8_packed_rows")
def op8_packed_rows(spark, sf_dir):
    ranks, pattern = public_vocabulary()
    coded = library_ids(table(spark, sf_dir, "documents"), ranks, pattern)
    return pack(coded, pad=len(ranks))  # the first free id
