"""Image sizes from file headers; no pixel is decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that are looked at; more than a JPEG's metadata before its frame header.
HEAD = 1 << 20


def _jpeg(b: bytes) -> tuple[int, int]:
    at = 2
    while True:
        while b[at] != 0xFF:
            at += 1
        while b[at] == 0xFF:
            at += 1
        mark = b[at]
        if mark == 0xD8 or mark == 0x01 or 0xD0 <= mark <= 0xD7:  # stands alone
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # frame header
            return struct.unpack(">HH", b[at + 4 : at + 8])
        elif mark in (0xD9, 0xDA):
            raise ValueError("no frame header")
        else:
            at += 1 + struct.unpack(">H", b[at + 1 : at + 3])[0]


def _tiff(b: bytes) -> tuple[int, int]:
    order = "<" if b[:2] == b"II" else ">"
    at = struct.unpack(order + "I", b[4:8])[0]
    found = {}
    for k in range(struct.unpack(order + "H", b[at : at + 2])[0]):
        tag, kind = struct.unpack(order + "HH", b[at + 2 + 12 * k : at + 6 + 12 * k])
        if tag in (256, 257):
            value = b[at + 10 + 12 * k : at + 14 + 12 * k]
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
    return found[257], found[256]


def _webp(b: bytes) -> tuple[int, int]:
    if b[12:16] == b"VP8X":
        w, h = (int.from_bytes(b[a : a + 3], "little") + 1 for a in (24, 27))
    elif b[12:16] == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        w, h = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    else:
        w, h = (v & 0x3FFF for v in struct.unpack("<HH", b[26:30]))
    return h, w


def header_size(head: bytes) -> tuple[int, int]:
    """Height and width in pixels by the header of a PNG, JPEG, BMP, WebP, TIFF or GIF file."""
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        w, h = struct.unpack(">II", head[16:24])
    elif head[:2] == b"\xff\xd8":
        h, w = _jpeg(head)
    elif head[:2] == b"BM":
        w, h = struct.unpack("<HH", head[18:22]) if struct.unpack("<I", head[14:18])[0] == 12 else struct.unpack("<ii", head[18:26])
        h = abs(h)  # negative where rows run downwards
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        h, w = _webp(head)
    elif head[:4] in (b"II*\0", b"MM\0*"):
        h, w = _tiff(head)
    elif head[:3] == b"GIF":
        w, h = struct.unpack("<HH", head[6:10])
    else:
        raise ValueError("unknown format")
    if h <= 0 or w <= 0:
        raise ValueError("empty image")
    return h, w


def header_sizes(files: DataFrame, content: str = "content", fallback: int = 640) -> DataFrame:
    """`files` with `height`, `width` and `status` in place of the bytes in `content`.

    A file whose header cannot be read, or without bytes, gets `fallback` for both and a
    status that says why; others have the status `OK`. A column of one of these names
    raises.
    """
    clash = {"height", "width", "status"} & {c.lower() for c in files.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    kept = [c for c in files.columns if c != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for head in batch.column("_head"):
                try:
                    rows.append((*header_size(head.as_py() or b""), "OK"))
                except (ValueError, IndexError, KeyError, struct.error) as exc:
                    rows.append((fallback, fallback, f"UNREADABLE {exc}" if isinstance(exc, ValueError) else "UNREADABLE cut short"))
            columns = list(zip(*rows)) or [(), (), ()]
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=[*kept, "height", "width", "status"])

    slim = files.select(*kept, F.substring(F.col(content), 1, HEAD).alias("_head"))
    fields = [f for f in files.schema.fields if f.name != content]
    ends = [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("status", T.StringType())]
    return slim.mapInArrow(run, T.StructType([*fields, *ends]))


def image_sizes(spark: SparkSession, folder: str, splits: Sequence[str] | None = None, fallback: int = 640, pattern: str | None = None) -> DataFrame:
    """``(path, height, width, status)`` of the files below `folder`, or below its `splits` only.

    Folders of other splits are not listed. Files come from any store that Spark reads; the
    first MiB of each reaches the helper. `pattern` is a glob for the file name.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        read = read.option("pathGlobFilter", pattern)
    paths = [f"{folder.rstrip('/')}/{s}" for s in splits] if splits is not None else [folder]
    return header_sizes(read.load(paths).select("path", "content"), fallback=fallback)
