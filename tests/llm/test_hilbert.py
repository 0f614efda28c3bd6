"""Shards along the curve: law, slots, locality and odd rows."""

import itertools
import zlib

from pyspark.sql import functions as F

from gridlark.llm.hilbert import document_facts, hilbert_index, hilbert_shards, write_shards
from gridlark.llm.registry import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, shard string"


def test_curve_visits_every_cell_in_unit_steps(spark):
    bits = 3
    grid = list(itertools.product(range(2**bits), repeat=3))
    rows = hilbert_index(spark.createDataFrame(grid, "a int, b int, c int"), ["a", "b", "c"], bits, "h").collect()
    path = [tuple(r)[:3] for r in sorted(rows, key=lambda r: r["h"])]
    assert sorted(r["h"] for r in rows) == list(range(8**bits))
    assert all(sum(abs(p - q) for p, q in zip(x, y)) == 1 for x, y in zip(path, path[1:]))


def placed(spark, rows, **kw):
    docs = spark.createDataFrame(rows, SCHEMA)
    facts = document_facts(docs).withColumn("shard", F.lit("mine"))
    return hilbert_shards(facts, ["lang", "source", "size"], ["doc_id", "size", "text_crc32"], **kw)


def test_law_and_slots_with_a_hot_cell_and_odd_rows(spark):
    rows = [(i, "same words " * 3, "en", "src0", "x") for i in range(500)]
    rows += [(1000 + i, "w" * (i % 90), f"l{i % 4}", f"s{i % 7}", "x") for i in range(301)]
    rows += [(None, None, None, None, None)] * 3 + [(5007, "", "en", None, "x"), (5008, "long " * 50000, "en", "src0", "x")]
    out = placed(spark, rows, pieces=64).collect()
    assert len(out) == len(rows) and out[0]["shard"] == "mine"
    by = {}
    for r in out:
        by.setdefault(r["_shard"], []).append(r["slot"])
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        text = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))


def test_fewer_rows_than_shards_and_none(spark):
    assert sorted(r["slot"] for r in placed(spark, [(1, "a", "x", "y", ""), (2, "b", "x", "y", "")]).collect()) == [0, 0]
    assert placed(spark, []).count() == 0


def test_files_prune_by_every_column(spark, tmp_path):
    rows = [(i, "w" * (1 + i % 64), f"l{i // 64 % 16:02}", f"s{i // 1024:02}", "") for i in range(16384)]
    docs = document_facts(spark.createDataFrame(rows, SCHEMA))
    write_shards(hilbert_shards(docs, ["lang", "source", "size"], ["doc_id"], shards=64), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows)
    for c in ("lang", "source", "size"):
        spread = back.groupBy("shard").agg(F.countDistinct(c).alias("n")).agg(F.avg("n")).first()[0]
        assert spread <= 0.45 * back.select(c).distinct().count()


def test_expressions_over_a_scan_and_own_names(spark):
    """Axes that are expressions of an unstored Parquet scan; columns named like working ones."""
    facts = document_facts(table(spark, SF, "documents"))
    out = hilbert_shards(facts.withColumnRenamed("text_crc32", "_place"), ["lang", "source", "size"], ["doc_id"])
    assert out.columns == ["doc_id", "lang", "source", "size", "_place", "shard", "slot"]
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1 and sum(counts) == facts.count()
