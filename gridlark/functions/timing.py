"""Column functions on clocks, deadlines and polar geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drift_ns(t0_ns: Column, raw_ns: Column, ppm: Column) -> Column:
    return (t0_ns + raw_ns * (F.lit(1.0) + ppm * 1e-6)).cast("bigint")


def ns_to_seconds(ns: Column) -> Column:
    return ns / F.lit(1e9)


def parse_deadline(text: Column, default_offset: str) -> Column:
    """ISO text to an instant; text without a zone gets `default_offset` such as +05:30."""
    zoned = text.rlike(r"([+-]\d{2}:?\d{2}|Z)$")
    return F.when(zoned, text).otherwise(F.concat(text, F.lit(default_offset))).try_cast("timestamp")


def past_deadline(text: Column, now: Column, default_offset: str, fallback: str) -> Column:
    """`fallback` replaces text that cannot be read."""
    return now >= F.coalesce(parse_deadline(text, default_offset), F.lit(fallback).cast("timestamp"))


def polar(x: Column, y: Column, vx: Column, vy: Column, ox: float, oy: float) -> dict[str, Column]:
    """Range, bearing and radial speed seen from (ox, oy), with image y pointing down."""
    dx, dy = x - ox, F.lit(float(oy)) - y
    rng = F.hypot(dx, dy)
    return {
        "range": rng,
        "bearing": F.atan2(dx, dy),
        "radial": (vx * dx + (-vy) * dy) / (rng + F.lit(1e-6)),
    }


def range_bin(rng: Column, max_range: float, bins: int) -> Column:
    return rng / max_range * (bins - 1)


def speed_bin(speed: Column, max_speed: float, bins: int) -> Column:
    return (speed / (2 * max_speed) + 0.5) * (bins - 1)
