"""Labels, tiles, readers, sinks, state, prototypes and plans on small inputs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gridlark.functions import boxes as B
from gridlark.functions import labels as L
from gridlark.functions import vectors as V
from gridlark.operators import prototypes, remap, sampling, tiles
from gridlark.operators.tracks import publish
from gridlark.sources import readers, sinks, state
from gridlark.sources.images import image_sizes


def parse(spark, lines, **options):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    out = df.select("i", L.parse_box_text(F.col("line"), F.lit(1920), F.lit(1080), **options).alias("b")).orderBy("i").collect()
    return [r.b for r in out]


def test_three_label_forms(spark):
    centre, pixel, outline, bad, empty, short = parse(
        spark,
        ["0 0.5 0.5 0.2 0.2", "192,108,192,216,1,4,0,0", "100 100 300 100 300 200 100 200 Plane 0", "x 1 2 3 4", "", "1 2 3"],
        class_map={4: 9}, text_map={"plane": 7},
    )
    assert (centre.cls, centre.xc) == (0, 0.5)
    assert (pixel.cls, pixel.xc, pixel.yc, pixel.bw, pixel.bh) == (9, pytest.approx(0.15), pytest.approx(0.2), pytest.approx(0.1), pytest.approx(0.2))
    assert (outline.cls, outline.xc, outline.bw) == (7, pytest.approx(200 / 1920), pytest.approx(200 / 1920))
    assert bad is None and empty is None and short is None


def test_unmapped_classes_by_form(spark):
    got = parse(
        spark, ["6 0.5 0.5 0.1 0.1", "0,0,10,10,1,6,0,0", "0 0 9 0 9 9 0 9 5 0", "0 0 9 0 9 9 0 9 boat 0", "1 .5 .5 .1 .1"],
        class_map={1: None, 2: 3}, text_map={},
    )
    assert [g.cls if g else None for g in got] == [6, None, 10, None, None]
    old = parse(spark, ["0 0 9 0 9 9 0 9 boat 0", "0,0,10,10,1,6,0,0"], class_map={}, text_map={}, csv=False, unknown_default=2)
    assert [g.cls if g else None for g in old] == [2, None]


def test_format_then_parse(spark):
    df = spark.createDataFrame([(3, 0.25, 0.5, 0.125, 0.0625)], "c int, x double, y double, w double, h double")
    line = L.format_box("c", "x", "y", "w", "h")
    row = df.select(line.alias("t"), L.parse_box_text(line, F.lit(10), F.lit(10)).alias("b")).first()
    assert row.t == "3 0.250000 0.500000 0.125000 0.062500"
    assert (row.b.cls, row.b.xc, row.b.yc, row.b.bw, row.b.bh) == (3, 0.25, 0.5, 0.125, 0.0625)


def test_rewrite(spark):
    df = spark.createDataFrame([("7.0 0.1 0.2 0.3 0.4 extra",), ("a b c d e",), ("1 2 3",), ("2 .1 .2 .3 .4",)], "line string")
    got = [r.t for r in df.select(L.rewrite_label(F.col("line"), {7: 1}).alias("t")).collect()]
    assert got == ["1 0.1 0.2 0.3 0.4 extra", None, None, None]


def test_remap_policies(spark):
    boxes = spark.createDataFrame([(0,), (1,), (2,), (99,)], "class_id int")
    m = spark.createDataFrame([("0", 10), ("1", 20), ("2", None)], "raw string, target int")
    run = lambda *a: sorted(r.class_id for r in remap.remap_classes(boxes, m, *a).collect())
    assert run() == [10, 20]
    assert run("default", 5) == [5, 10, 20]
    assert run("keep") == [10, 20, 99]
    with pytest.raises(ValueError):
        remap.remap_classes(boxes, m, "other")


def test_rule_order_decides(spark):
    df = spark.createDataFrame([("Armored-Car",), ("motorbike",), ("bird",), ("tree",)], "n string")
    rules = [(("car",), 1), (("armored",), 2), (("bike",), 3), (("motorbike",), 4)]
    assert [r.c for r in df.select(L.keyword_class(F.col("n"), rules, ("bird",)).alias("c")).collect()] == [1, 3, None, None]


def test_tiles_of_a_large_image(spark):
    images = spark.createDataFrame([(1, 1920, 1080), (2, 700, 700), (3, 400, 300)], "image_id int, width int, height int")
    grid = tiles.tile_grid(images, 640, 0.2).collect()
    mine = [r for r in grid if r.image_id == 1]
    assert {(r.tx1, r.ty1) for r in mine} >= {(0, 0), (1280, 440)}
    assert all(r.tx2 <= 1920 and r.ty2 <= 1080 and r.tx2 - r.tx1 == 640 for r in mine)
    assert [r.whole for r in grid if r.image_id == 3] == [True]
    small = tiles.tile_grid(images.where("image_id = 2"), 400, 0.2)
    assert small.count() > 1
    boxes = spark.createDataFrame([(2, 5, 0.5, 0.5, 0.2, 0.2)], "image_id int, class_id int, xc double, yc double, bw double, bh double")
    for fixed in (False, True):
        out = tiles.tile_project(images, boxes, 400, 0.2, fixed=fixed).collect()
        assert out and all(r.class_id == 5 and 0 <= r.xc <= 1 and 0 < r.bw <= 1 for r in out)


def test_expanded_tile_stays_inside(spark):
    rows = [(x, y, x + w, y + w, 640, 480) for x in (0, 300, 630) for y in (0, 200, 470) for w in (4, 9)] + [(5, 5, 9, 9, 100, 90)]
    df = spark.createDataFrame(rows, "x1 int, y1 int, x2 int, y2 int, w int, h int")
    out = df.select("w", "h", *[v.alias(n) for n, v in zip("abcd", B.expand_tile(B.box(), "w", "h", 320, 24))]).collect()
    assert all(0 <= r.a < r.c <= r.w and 0 <= r.b < r.d <= r.h for r in out)
    assert all(r.c - r.a == 320 for r in out if r.w == 640)


def test_publish_rules(spark):
    df = spark.createDataFrame(
        [(1, 1, True, 0, None, None), (2, 3, True, 0, "a", 0.5), (3, 3, True, 20, "a", 0.5), (4, 3, True, 1, "a", 0.05)],
        "id int, hits int, confirmed boolean, time_since_update int, gallery_class string, gallery_score double",
    )
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(publish(df)) == [2, 4]
    assert ids(publish(df, need_gallery=True)) == [2]
    assert ids(publish(df, enabled=False)) == [1, 2, 3, 4]


def test_prototypes_find_themselves(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 64))
    items = [(i, f"c{i % 6}", [float(v) for v in centres[i % 6] + 0.2 * rng.standard_normal(64)]) for i in range(60)]
    df = spark.createDataFrame(items, "i int, label string, v array<double>")
    codes = df.withColumn("code", V.encoder(64, 512)("v"))
    protos = prototypes.bundle(codes, "label", "code")
    got = prototypes.match(codes, protos, ["i"], "code").join(df, "i").collect()
    assert all(r.match == r.label and r.margin > 0 for r in got)


def test_many_prototype_blocks_equal_one(spark, monkeypatch):
    items = [(i, f"c{i % 7}", [((i * k) % 5) - 2.0 for k in range(1, 9)]) for i in range(21)]
    df = spark.createDataFrame(items, "i int, label string, code array<double>")
    protos = prototypes.bundle(df, "label", "code")
    run = lambda: sorted((r.i, r.match, round(r.score, 9), round(r.margin, 9)) for r in prototypes.match(df, protos, ["i"], "code").collect())
    one = run()
    monkeypatch.setattr(prototypes, "PACK", 2)
    assert run() == one


def test_empty_gallery(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0], 0.4), (2, [1.0, 1.0], 0.9)], "i int, code array<double>, conf double")
    none = spark.createDataFrame([], "label string, prototype array<int>")
    assert [(r.match, r.score, r.margin) for r in prototypes.match(df, none, ["i"], "code").collect()] == [(None, 0.0, 0.0)] * 2
    some = prototypes.match(df, none, ["i"], "code", conf="conf", conf_below=0.5).orderBy("i").collect()
    assert [r.score for r in some] == [0.0, None]


def test_files_in_and_out(spark, tmp_path):
    folder = tmp_path / "set"
    for name, text in (("a/one.txt", "0 .5 .5 .1 .1\n"), ("a/b/two.txt", "1 .5 .5 .1 .1\n"), ("a/pic.JPG", "not an image"), ("a/clip.mp4", "x")):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (folder / "a" / "bad.txt").write_bytes(b"2 .5 .5 .1 .1 \xff\xfe\n")
    found = readers.list_images(spark, str(folder)).collect()
    assert [os.path.basename(r.path) for r in found] == ["pic.JPG"]
    assert sorted(L_line.line[0] for L_line in readers.read_label_lines(spark, str(folder)).collect()) == ["0", "1", "2"]
    sizes = image_sizes(spark, str(folder / "a")).where(F.col("path").endswith("JPG")).collect()
    assert [(r.height, r.width) for r in sizes] == [(640, 640)]
    csv = tmp_path / "boxes.csv"
    csv.write_text("ImageID,LabelName,XMin,XMax,YMin,YMax\ni1,/m/1,0.1,0.3,0.2,0.4\ni2,/m/1,bad,0.3,0.2,0.4\ni3,/m/1,0.5,0.3,0.2,0.4\n")
    assert [r.image_id for r in readers.read_csv_boxes(spark, str(csv)).collect()] == ["i1"]
    mids = tmp_path / "mids.csv"
    mids.write_text("/m/1,Plane\n/m/2\n")
    assert [(r.mid, r.class_name) for r in readers.read_class_csv(spark, str(mids)).collect()] == [("/m/1", "Plane")]

    images = spark.createDataFrame([("p", "train"), ("q", "val")], "image string, split string")
    boxes = spark.createDataFrame([("p", 1, 1, 0.5, 0.5, 0.2, 0.2)], "image string, n int, class_id int, xc double, yc double, bw double, bh double")
    files = sinks.label_files(images, boxes, "image", "n")
    assert {r.image: r.text for r in files.collect()} == {"p": "1 0.500000 0.500000 0.200000 0.200000\n", "q": ""}
    sinks.write_label_files(files, str(tmp_path / "labels"), "image")
    back = spark.read.parquet(str(tmp_path / "labels")).collect()
    assert {(r.split, r.image, r.text) for r in back} == {("train", "p", "1 0.500000 0.500000 0.200000 0.200000\n"), ("val", "q", "")}
    names = spark.createDataFrame([(1, "b"), (0, "a")], "id int, name string")
    sinks.write_manifest(sinks.manifest(names, "x", ["train", "val"]), str(tmp_path / "manifest"))
    row = json.loads(next((tmp_path / "manifest").glob("*.json")).read_text())
    assert row == {"path": "x", "train": "images/train", "val": "images/val", "nc": 2, "names": {"0": "a", "1": "b"}}


def test_state_tables(spark, tmp_path):
    work = spark.createDataFrame([("a/b", "a_b"), ("c/d", "c_d"), ("e/f", "e_f")], "ref string, tag string")
    done = str(tmp_path / "done")
    state.mark_done(spark.createDataFrame([("a/b",)], "ref string"), done)
    state.mark_done(spark.createDataFrame([("c_d",)], "ref string"), done)
    assert [r.ref for r in state.skip_done(work, spark.read.parquet(done)).collect()] == ["e/f"]
    old = spark.createDataFrame([("k", "1", 1), ("m", "5", 1)], "key string, value string, version int")
    new = spark.createDataFrame([("k", "2", 2)], "key string, value string, version int")
    assert {r.key: r.value for r in state.merge_state(old, new).collect()} == {"k": "2", "m": "5"}


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 9, "z")], "k string, n int, v string")
    assert sorted((r.k, r.v) for r in sampling.first_per_key(df, ["k"], ["n"]).collect()) == [("a", "y"), ("b", "z")]


def test_equal_names_in_two_folders_keep_their_lines(spark):
    from gridlark.plans.dataset import prepare

    images = spark.createDataFrame([(f"d/{s}/images/a.jpg",) for s in ("train", "val")] + [("e/images/train/a.jpg",), ("e/images/b.jpg",)], "path string")
    lines = spark.createDataFrame(
        [("d/train/labels/a.txt", 1, "0 0.1 0.1 0.1 0.1"), ("d/val/labels/a.txt", 1, "1 0.2 0.2 0.2 0.2"), ("e/labels/train/a.txt", 1, "2 0.3 0.3 0.3 0.3")],
        "path string, line_no int, line string",
    )
    got = {(r.split, r.stem): r.text for r in prepare(images, lines, "p", {0: 5, 1: 6, 2: 7}).collect()}
    assert got == {
        ("train", "p_a"): "5 0.1 0.1 0.1 0.1\n", ("val", "p_a"): "6 0.2 0.2 0.2 0.2\n",
        ("train", "p_a_2"): "7 0.3 0.3 0.3 0.3\n", ("train", "p_b"): "",
    }


def test_cap_by_row_number_equals_cap_by_merging(spark):
    from gridlark.operators.sampling import capped

    df = spark.createDataFrame([(i, i * 7 % 50, None if i % 9 == 0 else f"p{i % 4}") for i in range(50)], "i int, a int, p string")
    for most in (0, 1, 17, 49, 80):
        one, two = (capped(df, ["p", df["a"]], most, few).collect() for few in (100, -1))
        assert {r.i for r in one} == {r.i for r in two} and len(two) == min(most, 50)


def test_smoothing_refuses_a_grid_with_holes(spark):
    from gridlark.operators.grids import smooth

    cells = [(1, r, d, float(r + d)) for r in range(4) for d in range(5)]
    full = spark.createDataFrame(cells, "map_id int, r int, d int, mag double")
    assert smooth(full).count() == 20
    for gone in (7, 19):
        with pytest.raises(Exception, match="holes"):
            smooth(full.where(f"r * 5 + d <> {gone}")).collect()


def test_prepare_reads_label_lines_once(spark):
    from gridlark.plans.dataset import prepare

    lines = spark.createDataFrame([("r/labels/a.txt", 0, "0 .5 .5 .1 .1"), ("r/labels/b.txt", 0, "no box")], "path string, line_no long, line string")
    images = spark.createDataFrame([("r/images/a.jpg",), ("r/images/b.jpg",), ("r/images/c.jpg",)], "path string")
    out = prepare(images, lines, "p", {0: 5}, keep_empty=False)
    assert sorted((r.stem, r.kept) for r in out.collect()) == [("p_a", 1), ("p_b", 0)]
    assert "line_no" not in out._jdf.queryExecution().analyzed().toString()  # the lines are not read again
