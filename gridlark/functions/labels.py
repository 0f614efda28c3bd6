"""Column functions on label text, class names and log text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.vectors import let


def tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def _num(x: Column) -> Column:
    return x.try_cast("double")


def _whole(x: Column) -> Column:
    """A plain integer token; anything else is NULL."""
    return F.when(F.trim(x).rlike(r"^[+-]?[0-9]+$"), F.trim(x).try_cast("int"))


def _lookup(mapping: dict, key: Column, missing: Column) -> Column:
    """`mapping` is a caller's small vocabulary; a None target gives NULL."""
    if not mapping:
        return missing
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v).cast("int"))])
    return F.when(key.isin(list(mapping)), F.element_at(table, key)).otherwise(missing)


def parse_box_text(
    line: Column,
    width: Column,
    height: Column,
    class_map: dict[int, int | None] | None = None,
    text_map: dict[str, int] | None = None,
    csv: bool = True,
    numeric_default: int | None = 10,
    unknown_default: int | None = None,
) -> Column:
    """One label line to ``struct<kind, cls, xc, yc, bw, bh>``, NULL when skipped.

    Five tokens are a centre box in frame shares; otherwise six or more comma
    fields are a pixel box; otherwise nine or more tokens are a four-corner outline
    whose envelope is taken. With ``csv=False`` the comma form is off and names
    outside `text_map` get `unknown_default`.
    """
    class_map = class_map or {}
    text_map = {k.lower(): v for k, v in (text_map or {}).items()}
    w = F.greatest(F.lit(1), width)
    h = F.greatest(F.lit(1), height)
    at = lambda arr, i: F.get(arr, F.lit(i))

    def row(kind, cls, xc, yc, bw, bh):
        return F.struct(
            F.lit(kind).alias("kind"), cls.alias("cls"), xc.alias("xc"), yc.alias("yc"), bw.alias("bw"), bh.alias("bh")
        )

    def centre(parts):
        raw = _whole(at(parts, 0))
        return row("centre", _lookup(class_map, raw, raw), *[_num(at(parts, i)) for i in range(1, 5)])

    def pixel(fields):
        left, top, bw, bh = (_num(at(fields, i)) for i in range(4))
        cls = _lookup(class_map, _whole(at(fields, 5)), F.lit(None).cast("int"))
        return row("pixel", cls, (left + bw / 2.0) / w, (top + bh / 2.0) / h, bw / w, bh / h)

    def outline(parts):
        name = F.lower(at(parts, 8))
        if csv:
            number = F.when(name.rlike("^[0-9]+$"), name.try_cast("int"))
            fallback = F.when(number.isNotNull(), _lookup(class_map, number, F.lit(numeric_default).cast("int")))
            cls = _lookup(text_map, name, fallback)
        else:
            cls = _lookup(text_map, name, F.lit(unknown_default).cast("int"))
            cls = _lookup(class_map, cls, cls)
        corners = F.transform(F.slice(parts, 1, 8), _num)
        axis = lambda odd: F.filter(corners, lambda v, i: i % 2 == odd)
        ends = F.struct(
            F.array_min(axis(0)).alias("x1"), F.array_max(axis(0)).alias("x2"),
            F.array_min(axis(1)).alias("y1"), F.array_max(axis(1)).alias("y2"),
            F.exists(corners, lambda v: v.isNull()).alias("bad"),
        )
        return let(
            ends,
            lambda e: F.when(
                ~e["bad"],
                row(
                    "outline", cls, (e["x1"] + e["x2"]) / (w * 2.0), (e["y1"] + e["y2"]) / (h * 2.0),
                    (e["x2"] - e["x1"]) / w, (e["y2"] - e["y1"]) / h,
                ),
            ),
        )

    def parse(p):
        parts, fields = p["parts"], p["fields"]
        n = F.size(parts)
        chain = F.when(n == 5, centre(parts))
        if csv:
            chain = chain.when(F.size(fields) >= 6, pixel(fields))
        return chain.when(n >= 9, outline(parts))

    # split the line once and bind the pieces
    pieces = F.struct(tokens(line).alias("parts"), F.split(F.trim(line), ",").alias("fields"))
    whole = lambda r: F.when(
        r["cls"].isNotNull() & r["xc"].isNotNull() & r["yc"].isNotNull() & r["bw"].isNotNull() & r["bh"].isNotNull(), r
    )
    return let(let(pieces, parse), whole)


def rewrite_label(line: Column, class_map: dict[int, int], default_cls: int | None = None) -> Column:
    """Replace the class token and keep the others word for word; NULL when dropped."""

    def rewrite(parts):
        raw = _num(F.get(parts, F.lit(0))).try_cast("int")
        cls = _lookup(class_map, raw, F.lit(default_cls).cast("int"))
        text = F.array_join(
            F.concat(F.array(cls.cast("string")), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))), " "
        )
        return F.when((F.size(parts) >= 5) & raw.isNotNull() & cls.isNotNull(), text)

    return let(tokens(line), rewrite)


def format_box(cls, xc, yc, bw, bh) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, xc, yc, bw, bh)


def normalise_name(name: Column) -> Column:
    return F.trim(F.translate(F.lower(name), "-_", "  "))


def keyword_class(name: Column, rules: Sequence[tuple[Sequence[str], int]], stop: Sequence[str] = ()) -> Column:
    """First rule, in the given order, with a keyword inside the normalised name."""
    text = normalise_name(name)
    chain = F.when(text.isin(list(stop)), F.lit(None).cast("int")) if stop else None
    for words, cls in rules:
        # a whole-name or whole-token hit is also a substring hit
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        chain = F.when(hit, F.lit(cls)) if chain is None else chain.when(hit, F.lit(cls))
    return chain


def split_of_folder(path: Column) -> Column:
    """train or val from a path whose `images` folder sits beside or above the split name."""
    low = F.lower(path)
    held_out = low.rlike(r"(^|/)images/(val|valid|val2017)/") | low.rlike(r"(^|/)(val|valid|validation|test)/images/")
    return F.when(held_out, F.lit("val")).otherwise(F.lit("train"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def has_error(text: Column, marks: Sequence[str], tail: int = 2000) -> Column:
    """Any of the marks in the last `tail` characters, ignoring case."""
    low = F.lower(F.right(text, F.lit(tail)))
    hit = F.lit(False)
    for mark in marks:
        hit = hit | low.contains(mark)
    return hit
