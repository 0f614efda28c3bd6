"""Column functions on boxes. All are plain expressions inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + n) for n in ("x1", "y1", "x2", "y2"))


def area(b) -> Column:
    x1, y1, x2, y2 = b
    zero = F.lit(0).cast("double")
    return F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def area_int(b) -> Column:
    x1, y1, x2, y2 = b
    return F.greatest(F.lit(0), x2 - x1) * F.greatest(F.lit(0), y2 - y1)


def _clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(v, lo), hi)


def clip(b, width, height) -> tuple[Column, Column, Column, Column]:
    """Integer clip: the near edges stay one pixel inside, the far ones reach the frame."""
    x1, y1, x2, y2 = b
    w, h = _c(width), _c(height)
    zero, one = F.lit(0), F.lit(1)
    return _clamp(x1, zero, w - 1), _clamp(y1, zero, h - 1), _clamp(x2, one, w), _clamp(y2, one, h)


def center(b) -> tuple[Column, Column]:
    x1, y1, x2, y2 = b
    return (x1 + x2) * 0.5, (y1 + y2) * 0.5


def intersection(a, b) -> Column:
    zero = F.lit(0.0)
    dx = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    dy = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(zero, dx) * F.greatest(zero, dy)


def iou(a, b) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlaps(a, b) -> Column:
    """True when the intersection has positive area."""
    return (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & (F.least(a[3], b[3]) > F.greatest(a[1], b[1]))


def cover(inner, outer) -> Column:
    """Share of `inner` that lies in `outer`; 0 for an empty box."""
    size = area(inner)
    return F.when(size > 0, intersection(inner, outer) / size).otherwise(F.lit(0.0))


def explained(roi, track, iou_min: float = 0.25, cover_min: float = 0.5) -> Column:
    return (
        (iou(roi, track) >= iou_min) | (cover(roi, track) >= cover_min) | (cover(track, roi) >= cover_min)
    )


def normalise(b, width, height) -> tuple[Column, Column, Column, Column]:
    w = F.greatest(F.lit(1), _c(width))
    h = F.greatest(F.lit(1), _c(height))
    zero, one = F.lit(0.0), F.lit(1.0)
    return tuple(_clamp(v / d, zero, one) for v, d in zip(b, (w, h, w, h)))


def to_cxcywh(b) -> tuple[Column, Column, Column, Column]:
    x1, y1, x2, y2 = b
    w, h = x2 - x1, y2 - y1
    return x1 + w / 2.0, y1 + h / 2.0, w, h


def to_xyxy(xc, yc, w, h) -> tuple[Column, Column, Column, Column]:
    return xc - w / 2.0, yc - h / 2.0, xc + w / 2.0, yc + h / 2.0


def offset(b, dx, dy) -> tuple[Column, Column, Column, Column]:
    dx, dy = _c(dx), _c(dy)
    return b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy


def letterbox(width, height, size: int) -> dict[str, Column]:
    """Scale to a square canvas; sides truncate towards zero."""
    w, h = _c(width), _c(height)
    longest = F.greatest(w, h)
    scale = F.lit(size) / longest
    return {
        "scale": scale,
        "new_w": (w * scale).cast("int"),
        "new_h": (h * scale).cast("int"),
        "inverse": longest / F.lit(float(size)),
    }


def pad_roi(b, pad: int, width, height) -> tuple[Column, Column, Column, Column]:
    x1, y1, x2, y2 = (v.cast("int") for v in b)
    return clip((x1 - pad, y1 - pad, x2 + pad, y2 + pad), width, height)


def _half(v: Column) -> Column:
    return F.floor(v / 2).cast("int")


def expand_tile(b, width, height, min_side: int = 320, pad: int = 24) -> tuple[Column, Column, Column, Column]:
    """Square window around an integer box, pushed back inside the frame."""
    w, h = _c(width), _c(height)
    x1, y1, x2, y2 = b
    side = F.greatest(F.lit(min_side), x2 - x1 + 2 * pad, y2 - y1 + 2 * pad)

    def axis(a, z, limit):
        start = _half(a + z) - _half(side)
        # shift right off the near edge, then left off the far edge
        start = F.greatest(start, F.lit(0))
        start = start - F.greatest(start + side - limit, F.lit(0))
        return F.greatest(F.lit(0), start), F.least(start + side, limit)

    ax, bx = axis(x1, x2, w)
    ay, by = axis(y1, y2, h)
    return clip((ax, ay, bx, by), w, h)


def is_tiny(b, width, height, frac: float = 0.035) -> Column:
    """`b` is an already clipped integer box."""
    return area_int(b) < F.lit(frac) * F.greatest(F.lit(1), _c(width) * _c(height))


def decode_scores(scores: Column, cxcywh, frame_scale: Column):
    """First best class, its score, and the box scaled back to the frame."""
    best = F.array_max(scores)
    cls = (F.array_position(scores, best) - 1).cast("int")
    corners = to_xyxy(*cxcywh)
    return cls, best, tuple(v * frame_scale for v in corners)


def colour_bucket(red: Column, green: Column, blue: Column, floor: float = 80) -> Column:
    return (
        F.when((red >= green) & (red >= blue) & (red > floor), "red")
        .when((blue >= green) & (blue >= red) & (blue > floor), "blue")
        .when((green >= red) & (green >= blue) & (green > floor), "green")
        .otherwise("object")
    )
