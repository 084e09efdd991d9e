"""Integer half-open boxes ``[x, x+w) x [y, y+h)`` as column expressions."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, alias: str = "", prefix: str = "") -> "Box":
        """The box held by columns ``{prefix}x, {prefix}y, ...`` of a table alias."""
        dot = f"{alias}." if alias else ""
        return cls(*(F.col(f"{dot}{prefix}{k}") for k in "xywh"))

    @classmethod
    def corners(cls, x0: Column, y0: Column, x1: Column, y1: Column) -> "Box":
        return cls(x0, y0, x1 - x0, y1 - y0)

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.greatest(self.w.cast("bigint"), zero) * F.greatest(self.h.cast("bigint"), zero)

    @property
    def centre(self) -> tuple[Column, Column]:
        return self.x + self.w / 2.0, self.y + self.h / 2.0

    def clip(self, x0: Column, y0: Column, x1: Column, y1: Column) -> "Box":
        return Box.corners(F.greatest(self.x, x0), F.greatest(self.y, y0),
                           F.least(self.right, x1), F.least(self.bottom, y1))

    def columns(self, prefix: str = "") -> list[Column]:
        return [value.alias(f"{prefix}{name}") for name, value in zip("xywh", self)]


def intersection(a: Box, b: Box) -> Column:
    width = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    height = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    zero = F.lit(0).cast("bigint")
    return F.greatest(width.cast("bigint"), zero) * F.greatest(height.cast("bigint"), zero)


def overlaps(a: Box, b: Box) -> Column:
    return (a.x < b.right) & (b.x < a.right) & (a.y < b.bottom) & (b.y < a.bottom)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the union is empty."""
    common = intersection(a, b)
    union = a.area + b.area - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def eval_iou(a: Box, b: Box) -> Column:
    """IoU with the evaluation's guarded denominator."""
    common = intersection(a, b)
    return common / F.greatest(F.lit(1).cast("bigint"), a.area + b.area - common)


def pair_geometry(a: Box, b: Box) -> dict[str, Column]:
    """IoU, overlap over the smaller area, scaled centre distance and area ratio."""
    common = intersection(a, b)
    small, large = F.least(a.area, b.area), F.greatest(a.area, b.area)
    one = F.lit(1).cast("bigint")
    (ax, ay), (bx, by) = a.centre, b.centre
    scale = F.greatest(F.lit(1.0), F.least(F.hypot(a.w.cast("double"), a.h.cast("double")),
                                           F.hypot(b.w.cast("double"), b.h.cast("double"))))
    return {
        "iou": iou(a, b),
        "overlap": F.when(small > 0, common / small).otherwise(F.lit(0.0)),
        "distance": F.hypot(ax - bx, ay - by) / scale,
        "ratio": small / F.greatest(large, one),
    }


def appearance_similarity(a: Column, b: Column) -> Column:
    """Histogram intersection; null when either side has no histogram."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double"))
    common = total(F.zip_with(a, b, lambda p, q: F.least(p, q)))
    value = common / F.greatest(total(a), total(b), F.lit(1e-9))
    return F.when((F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0), value)


def restore_box(box: Column, window: Box, normalized: Column) -> Column:
    """Local corner array -> absolute box struct inside ``window``; null when invalid."""
    finite = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    unit = F.forall(box, lambda v: (v >= 0.0) & (v <= 1.0))
    sx = F.when(normalized, window.w.cast("double")).otherwise(1.0)
    sy = F.when(normalized, window.h.cast("double")).otherwise(1.0)
    at = lambda i: F.get(box, F.lit(i))
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    x0, y0 = F.floor(clip(at(0) * sx, window.w)), F.floor(clip(at(1) * sy, window.h))
    x1, y1 = F.ceil(clip(at(2) * sx, window.w)), F.ceil(clip(at(3) * sy, window.h))
    good = (F.size(box) == 4) & finite & (~normalized | unit)
    placed = F.struct((window.x + x0).cast("bigint").alias("x"), (window.y + y0).cast("bigint").alias("y"),
                      (x1 - x0).cast("bigint").alias("w"), (y1 - y0).cast("bigint").alias("h"))
    return F.when(good, F.when((x1 > x0) & (y1 > y0), placed))


def truncated_edges(box: Box, window: Box, width: Column, height: Column, threshold: int = 12) -> Column:
    """Window borders the box touches, scene borders excepted; left, top, right, bottom."""
    hits = [
        ("left", (window.x > 0) & (box.x - window.x <= threshold)),
        ("top", (window.y > 0) & (box.y - window.y <= threshold)),
        ("right", (window.right < width) & (window.right - box.right <= threshold)),
        ("bottom", (window.bottom < height) & (window.bottom - box.bottom <= threshold)),
    ]
    return F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in hits)))


def expand(box: Box, padding: int, width: Column, height: Column) -> Box:
    """Box grown by ``padding`` on each side and clipped to the scene."""
    zero = F.lit(0)
    return Box.corners(F.greatest(zero, box.x - padding), F.greatest(zero, box.y - padding),
                       F.least(width, box.right + padding), F.least(height, box.bottom + padding))


def half_even(value: Column) -> Column:
    """Rounding of halves to the even neighbour."""
    return F.bround(value, 0).cast("bigint")


def portable(path: Column, root: str) -> Column:
    """Path relative to ``root`` when below it; otherwise unchanged."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(path)


def portable_strict(path: Column, root: str) -> Column:
    """As ``portable``, but an absolute path outside ``root`` is an error."""
    prefix = root.rstrip("/") + "/"
    inside = F.substring(path, len(prefix) + 1, 1 << 20)
    return (F.when(path.isNull() | path.startswith(prefix), inside)
            .when(path.startswith("/"), F.raise_error(F.concat(F.lit("path outside the output folder: "), path)))
            .otherwise(path))
