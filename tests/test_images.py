"""Image sizes by header: formats, odd files, pruning of split folders."""

import struct

import pytest

from gridlark.sources.images import header_size, header_sizes, image_sizes

PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 70, 50) + b"\x08\x06\0\0\0"
JPEG = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 60000) + b"\xff\xc0" * 29999 + b"\xff\xff\xc4\0\x04ab" + b"\xff\xc2\0\x11\x08" + struct.pack(">HH", 50, 70)
CASES = [
    PNG,
    JPEG,
    b"BM" + bytes(12) + struct.pack("<Iii", 40, 70, -50),
    b"BM" + bytes(12) + struct.pack("<IHH", 12, 70, 50),
    b"GIF89a" + struct.pack("<HH", 70, 50),
    b"RIFF0000WEBPVP8X" + bytes(8) + (69).to_bytes(3, "little") + (49).to_bytes(3, "little"),
    b"RIFF0000WEBPVP8L" + bytes(5) + (69 | 49 << 14).to_bytes(4, "little"),
    b"RIFF0000WEBPVP8 " + bytes(10) + struct.pack("<HH", 70, 50),
    b"MM\0*" + struct.pack(">IHHHIHHHHII", 8, 2, 256, 3, 1, 70, 0, 257, 4, 1, 50),
]
BAD = [b"", b"text", PNG[:20], b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xe0", b"II*\0\x08\0\0\0\x01\0", PNG[:16] + bytes(8)]


@pytest.mark.parametrize("head", CASES)
def test_formats(head):
    assert header_size(head) == (50, 70)


def test_rows(spark):
    rows = [(k, bytearray(b), "x") for k, b in enumerate(CASES + BAD)] + [(99, None, "x")]
    df = spark.createDataFrame(rows, "id int, content binary, _head string")
    got = {r["id"]: (r["height"], r["width"], r["status"]) for r in header_sizes(df.drop("_head"), fallback=3).collect()}
    assert len(got) == len(rows)
    for k in got:
        if k < len(CASES):
            assert got[k] == (50, 70, "OK")
        else:
            assert got[k][:2] == (3, 3) and got[k][2].startswith("UNREADABLE")
    assert header_sizes(df.drop("_head").limit(0)).count() == 0
    with pytest.raises(ValueError, match="status"):
        header_sizes(df.withColumnRenamed("_head", "Status"))


def test_only_wanted_splits_are_listed(spark, tmp_path):
    for split, head in (("train", PNG), ("val", JPEG), ("test", b"bad")):
        (tmp_path / split / "deep").mkdir(parents=True)
        (tmp_path / split / "deep" / f"{split}.png").write_bytes(head)
    some = image_sizes(spark, str(tmp_path), ["train", "val"]).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.height, r.width, r.status) for r in some) == [("train.png", 50, 70, "OK"), ("val.png", 50, 70, "OK")]
    assert image_sizes(spark, str(tmp_path)).count() == 3
