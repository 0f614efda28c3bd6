"""Byte-level BPE by a sentencepiece model written straight from a rank file.

Every byte stands for one character, every rank for a piece of such characters scored by
its negative rank, and the normaliser is the identity. Merging the best-scored neighbours
is then the merging of the lowest rank. Texts are split by the pattern first; decoding
maps ids to the bytes of their pieces.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2 as spm

from gridlark.llm.columns import free_name
from gridlark.llm.registry import query, table

#: Letters and numbers assigned after Unicode 16, the version of the library
#: whose splits are to be met. They count as neither here, whatever `regex` knows.
LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_FIRST_LATER = chr(min(int(r.split("-")[0], 16) for r in LATER.split()))
#: Byte b is this plus b: letters without a meaning of their own to the model.
FIRST_CHAR = 0x4E00
_KNOWN = 200_000  # pre-tokens a worker remembers; beyond it starts afresh
_SLICE_BYTES = 2_000_000  # text of one output batch


def read_ranks(path: str) -> dict[bytes, int]:
    """``token rank`` lines, the token in base 64."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def as_chars(token: bytes) -> str:
    return "".join(chr(FIRST_CHAR + b) for b in token)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece number r is the token of rank r, the last is unknown."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    m = spm.ModelProto()
    for r, token in enumerate(tokens):
        m.pieces.add(piece=as_chars(token), score=-float(r), type=spm.ModelProto.SentencePiece.NORMAL)
    m.pieces.add(piece="<unk>", score=0.0, type=spm.ModelProto.SentencePiece.UNKNOWN)
    m.trainer_spec.model_type = spm.TrainerSpec.BPE
    m.trainer_spec.vocab_size = len(m.pieces)
    m.trainer_spec.unk_id = len(tokens)
    m.trainer_spec.bos_id = m.trainer_spec.eos_id = m.trainer_spec.pad_id = -1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = False
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = False
    return m.SerializeToString()


def _later() -> str:
    ends = [r.split("-") for r in LATER.split()]
    return "[" + "".join(f"{chr(int(e[0], 16))}-{chr(int(e[-1], 16))}" for e in ends) + "]"


class Codec:
    """Encodes and decodes with one model; remembers the pre-tokens it has met."""

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern, self.later = regex.compile(pattern), regex.compile(_later())
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size() - 1)]
        self.bytes_of = [bytes(ord(c) - FIRST_CHAR for c in p) for p in pieces]
        # a pre-token that is a token as a whole is never merged
        self.whole = {b: i for i, b in enumerate(self.bytes_of)}
        self.chars = [chr(FIRST_CHAR + b) for b in range(256)]
        self.known: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        # no character before these is one of them
        if text.isascii() or max(text) < _FIRST_LATER or self.later.search(text) is None:
            return self.pattern.findall(text)
        plain = self.later.sub("\ue000", text)  # a private character: no letter, number or space
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]

    def encode(self, text: str) -> array:
        pre = self.split(text)
        new = [p for p in set(pre) if p not in self.known]
        if new:
            if len(self.known) > _KNOWN:
                self.known.clear()
                new = list(set(pre))
            merged = []
            for p in new:
                raw = p.encode()
                if raw in self.whole:
                    self.known[p] = (self.whole[raw],)
                else:
                    merged.append(p)
            mapped = ["".join(map(self.chars.__getitem__, p.encode())) for p in merged]
            for p, ids in zip(merged, self.model.encode(mapped, num_threads=1) if mapped else []):
                self.known[p] = tuple(ids)
        return array("I", chain.from_iterable(map(self.known.__getitem__, pre)))

    def decode(self, ids: bytes) -> bytes:
        a = array("I")
        a.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, a))


@lru_cache(maxsize=2)
def _codec(key: str, model, pattern: str) -> Codec:
    return Codec(model.value, pattern)


class _Shared:
    """A broadcast model that hashes by its content's digest, for the workers' cache."""

    def __init__(self, spark, model: bytes, pattern: str):
        self.model, self.pattern = spark.sparkContext.broadcast(model), pattern
        self.key = hashlib.sha256(model + pattern.encode()).hexdigest()

    def codec(self) -> Codec:
        return _codec(self.key, self.model, self.pattern)


def _slices(batches, column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows with the values of `column`, whose bytes stay near the bound."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + _SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start), values.slice(start, stop - start).to_pylist()
            start = stop


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """Add `n_tokens` and `ids`, the token ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and gives no ids; strings of special tokens are ordinary
    text. All columns, rows and repeats stay; new names that clash get a leading
    underscore. Texts are taken whole, one at a time, in the tasks that read them:
    nothing is shuffled, and the model, of the size of the vocabulary, is broadcast.
    """
    n, ids = free_name(docs, "n_tokens"), free_name(docs, "ids")
    shared = _Shared(docs.sparkSession, model_bytes(ranks), pattern)

    def run(batches):
        codec = shared.codec()
        for batch, texts in _slices(batches, text):
            coded = [codec.encode(t or "") for t in texts]
            counts = pa.array([len(c) for c in coded], pa.int64())
            packed = pa.array([c.tobytes() for c in coded], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts, packed], names=[*batch.schema.names, n, ids])

    fields = [StructField(n, LongType()), StructField(ids, BinaryType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))


def decode(coded: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids") -> DataFrame:
    """Add `decoded`, the bytes that the ids in column `ids` stand for; null ids give none."""
    name = free_name(coded, "decoded")
    shared = _Shared(coded.sparkSession, model_bytes(ranks), pattern)

    def run(batches):
        codec = shared.codec()
        for batch, packed in _slices(batches, ids):
            got = pa.array([codec.decode(b or b"") for b in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, name])

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField(name, BinaryType())]))


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode, decode the ids again, and put counts and digests in place of the text.

    Gives the other columns of `docs` with `n_tokens`, `ids_sha256` and `decoded_sha256`
    (lowercase hex), and with `ids` if they are to be kept, as `encode` and `decode`
    would, in one pass.
    """
    others = docs.drop(text)
    kinds = {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()} | ({"ids": BinaryType()} if keep_ids else {})
    names = [free_name(others, c) for c in kinds]
    shared = _Shared(docs.sparkSession, model_bytes(ranks), pattern)

    def run(batches):
        codec = shared.codec()
        for batch, texts in _slices(batches, text):
            counts, coded, back, kept = [], [], [], []
            for t in texts:
                ids = codec.encode(t or "")
                packed = ids.tobytes()
                counts.append(len(ids))
                coded.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(codec.decode(packed)).hexdigest())
                if keep_ids:
                    kept.append(packed)
            rest = batch.drop_columns([text])
            made = [pa.array(counts, pa.int64()), pa.array(coded), pa.array(back)] + [pa.array(kept, pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays([*rest.columns, *made], names=[*rest.schema.names, *names])

    return docs.mapInArrow(run, StructType([*others.schema.fields, *[StructField(n, k) for n, k in zip(names, kinds.values())]]))


def public_vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@query("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, *public_vocabulary())
