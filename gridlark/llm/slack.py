"""Sequences packed from token ids by minimum bin slack.

A bin starts with the longest piece left; a subset-sum over the lengths that are left,
kept as bits of one number per length, finds what fills the rest best. Such a combination
is used as often as its pieces last, so that each bin is the fullest feasible one while
the search only ever sees how many pieces there are of each length: at most one count per
token of a bin, whatever the size of the corpus. Pieces are then dealt to the
combinations by their rank among the pieces of equal length, in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from gridlark.llm.columns import broadcast_if_small
from gridlark.llm.registry import query, table
from gridlark.session import stored_table

ROOM = 2048
VOCABULARY = "word_bpe_49k.json"
WORDS_KEPT, PARTS_KEPT = 600_000, 400_000  # words and pre-tokens whose ids a worker remembers
_PLAIN = regex.compile(r"[!-~\u00a1-\u012f\n]+")

#: Normalisation and pre-tokens of such a file never look across ASCII white space.
_WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Remembered:
    """Values by key, made in bulk; all are forgotten once there are `most`."""

    def __init__(self, most: int, make: Callable[[list], Iterable[bytes]]):
        self.most, self.make = most, make
        self.known: dict = {}

    def of(self, keys: list) -> list[bytes]:
        """The values of `keys`, in order."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        got = list(map(known.get, keys))
        if None not in got:
            return got
        fresh = list({k for k, v in zip(keys, got) if v is None})
        known.update(zip(fresh, self.make(fresh)))
        return [known[k] if v is None else v for k, v in zip(keys, got)]


class Coder:
    """Ids of texts as the tokenizer of a file gives them, without special tokens added.

    Words are encoded once and remembered. Those of plain Latin characters are cut into
    their pre-tokens here, as the file's pattern says, and only new pre-tokens are encoded.
    """

    def __init__(self, spec: str):
        self.own = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        self.wordwise = all(parsed.get(k) == v for k, v in _WORDWISE.items()) and not any(
            t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in parsed["added_tokens"]
        )
        if self.wordwise:
            self.pieces = regex.compile(_WORDWISE["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
            self.special = regex.compile("|".join(regex.escape(t["content"]) for t in parsed["added_tokens"]) or "(?!)")
            self.bare = Tokenizer.from_str(spec)  # of pre-tokens
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.words = Remembered(WORDS_KEPT, self._words)
            self.parts = Remembered(PARTS_KEPT, lambda new: self._listed(self.bare, new))

    @staticmethod
    def _listed(coder: Tokenizer, new: list[str]) -> list[bytes]:
        if not new:
            return []
        got = coder.encode(new, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, "<u4").tobytes()
        cut = (4 * np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(new) + 1))).tolist()
        return [ids[a:z] for a, z in zip(cut, cut[1:])]

    def _words(self, new: list[bytes]) -> list[bytes]:
        blob = b"\n".join(new).decode()
        texts = blob.split("\n")
        if not _PLAIN.fullmatch(blob) or self.special.search(blob):
            plain = [bool(_PLAIN.fullmatch(t)) and not self.special.search(t) for t in texts]
            other = iter(self._listed(self.own, [t for t, p in zip(texts, plain) if not p]))
            simple = iter(self._plain([t for t, p in zip(texts, plain) if p]))
            return [next(simple) if p else next(other) for p in plain]
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> list[bytes]:
        # below U+0130 composing changes nothing and lower case looks at one character
        if not texts:
            return []
        parts = self.pieces.findall("\n".join(texts).lower())
        out, word = [], []
        for p, v in zip(parts, self.parts.of(parts)):
            if p == "\n":
                out.append(word[0] if len(word) == 1 else b"".join(word))
                word = []
            else:
                word.append(v)
        out.append(b"".join(word))
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.wordwise:
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.encode().split()
        return b"".join(b"".join(self.words.of(words[at : at + 20_000])) for at in range(0, len(words), 20_000))


_CODERS: dict[str, Coder] = {}  # one per worker process and file


def public_pieces(docs: DataFrame, room: int = ROOM, end: int | None = 0, path: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: the texts' ids, then `end`, cut into pieces.

    Only documents of more than `room` ids are cut; the last piece may be shorter. A null
    text is empty; without `end` it gives no piece. `path` is a tokenizer file that
    every worker can read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches):
        if path not in _CODERS:
            with open(path, encoding="utf-8") as f:
                _CODERS[path] = Coder(f.read())
        coder = _CODERS[path]
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                row, piece, start, ids = [], [], [], []
                for k, text in enumerate(b.column("text").to_pylist()):
                    coded = coder.ids(text or "") + tail
                    for n, at in enumerate(range(0, len(coded), 4 * room)):
                        row.append(k)
                        piece.append(n)
                        start.append(at // 4)
                        ids.append(coded[at : at + 4 * room])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids binary")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill a bin best, the longest length among them.

    `reach` has bit s set if some of the lengths seen so far sum to s. Lengths come
    longest first, each in powers of two up to its count, and the walk back from the
    highest sum takes a length only where the sum cannot be had without it.
    """
    longest = max(counts)
    left = room - longest
    mask = (1 << (left + 1)) - 1
    reach, steps = 1, []
    for n in sorted((n for n in counts if n <= left), reverse=True):
        have = min(counts[n] - (n == longest), left // n)
        block = 1
        while have > 0:
            take = min(block, have)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            have -= take
            block *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    out = {longest: 1}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + take
            at -= n * take
    return out


def combinations(counts: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Combinations and how often each is used, until no piece is left.

    Each leaves of some length fewer pieces than one use of it took, so a length ends
    after as many combinations as a bin's room has bits, at most.
    """
    counts, out = {n: c for n, c in counts.items() if c}, []
    while counts:
        best = fullest(counts, room)
        times = min(counts[n] // k for n, k in best.items())
        out.append((best, times))
        for n, k in best.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return out


def _deals(made: list[tuple[dict[int, int], int]], room: int) -> tuple[np.ndarray, ...]:
    """Where the pieces of a length go by rank: ranges `(key, sequence, per, offset)`."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for best, times in made:
        offset = 0
        for n, k in best.items():
            rows.append((n << 48 | used.get(n, 0), sequence, k, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return tuple(np.array(sorted(rows) or np.empty((0, 4)), np.int64).T)


def pack_tightly(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`: where each lies in its sequence.

    `pieces` has `length` in tokens, 0 to `room` (null or anything else raises), and any
    other columns but `sequence_id` and `offset`; names that start with an underscore
    are taken too. Sequences hold at most `room` tokens, are filled from offset 0 without
    a gap and are numbered from 0. Empty pieces all lie at offset 0 of sequence 0.
    Repeated rows are packed each; no rows give no rows.

    The pieces are written once with their rank among equal lengths of their task; ranks
    become global by the counts per task and length. Nothing else moves: the counts are
    broadcast while they are few, else pieces and counts meet by task.
    """
    clash = {"sequence_id", "offset", "_task", "_rank"} & {c.lower() for c in pieces.columns}
    if clash or not 0 < room < 1 << 15:
        raise ValueError(f"columns {sorted(clash)} are taken" if clash else "a sequence has 1 to 32767 tokens")
    kept = pieces.schema

    def ranked(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        for b in batches:
            n = b.column("length")
            sizes = np.array([-1], np.int64) if n.null_count else n.to_numpy()
            if sizes.min(initial=0) < 0 or sizes.max(initial=0) > room:
                raise ValueError(f"lengths are 0 to {room}")
            order = np.argsort(sizes, kind="stable")
            line = sizes[order]
            first = np.searchsorted(line, line)
            rank = np.empty(len(line), np.int64)
            rank[order] = np.arange(len(line)) - first + seen[line]
            seen += np.bincount(line, minlength=room + 1)
            columns = [*b.columns, pa.array(np.full(len(line), task, np.int32)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "_task", "_rank"])

    typed = pieces.withColumn("length", F.col("length").cast("bigint"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema)
    stored = stored_table(typed.mapInArrow(ranked, f"{schema}, _task int, _rank bigint"))
    per_task = stored_table(stored.groupBy("_task", F.col("length").alias("_n")).count())
    earlier = W.partitionBy("_n").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    counts = {r["_n"]: r["n"] for r in per_task.groupBy("_n").agg(F.sum("count").alias("n")).where("_n > 0").collect()}
    keys, sequence, per, offset = _deals(combinations(counts, room), room)
    deals = pieces.sparkSession.sparkContext.broadcast((keys, sequence, per, offset))
    before = per_task.select("_task", "_n", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    before = broadcast_if_small(stored_table(before), 400_000)
    found = stored.join(before, (stored["_task"] == before["_task"]) & (stored["length"] == before["_n"]))
    found = found.select(*[stored[f"`{f.name}`"] for f in kept], (stored["_rank"] + before["_before"]).alias("_rank"))

    def placed(batches):
        keys, sequence, per, offset = deals.value
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, n << 48 | rank, "right") - 1
            full = n > 0
            at = np.where(full, at, 0) if len(keys) else None
            if at is None:
                where = lie = np.zeros(len(n), np.int64)
            else:
                local = (n << 48 | rank) - keys[at]
                where = np.where(full, sequence[at] + local // per[at], 0)
                lie = np.where(full, offset[at] + n * (local % per[at]), 0)
            columns = [b.column(f.name) for f in kept] + [pa.array(where), pa.array(lie)]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return found.mapInArrow(placed, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, starts)``: the packed sequences' ids and where pieces begin."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return whole.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.col("p.offset").alias("starts"))


@query("op11_minimum_bin_slack")
def op11_minimum_bin_slack(spark, sf_dir):
    packed = pack_tightly(public_pieces(table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
