"""Column builders for boxes, structs of x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x, y, w, h) -> Column:
    parts = {"x": x, "y": y, "w": w, "h": h}
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in parts.items()])


def area(a: Column) -> Column:
    return a["w"] * a["h"]


def overlap(a: Column, b: Column) -> Column:
    """Common area."""
    side = [F.greatest(F.lit(0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p])) for p, s in (("x", "w"), ("y", "h"))]
    return side[0] * side[1]


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Share of a that lies in b."""
    both = overlap(a, b)
    return F.when(both > 0, both / area(a)).otherwise(0.0)


def overlap_score(a: Column, b: Column) -> Column:
    return F.greatest(iou(a, b), containment(a, b))


def _whole(c: Column) -> Column:
    return F.bround(c, 0).cast("long")


def scale_box(a: Column, scale: Column, width: Column, height: Column) -> Column:
    """One scale for both axes, rounded half to even, at least one pixel, clipped to the bounds."""
    x = F.greatest(F.lit(0), F.least(_whole(a["x"] * scale), width - 1))
    y = F.greatest(F.lit(0), F.least(_whole(a["y"] * scale), height - 1))
    w = F.greatest(F.lit(1), F.least(_whole(a["w"] * scale), width - x))
    h = F.greatest(F.lit(1), F.least(_whole(a["h"] * scale), height - y))
    return box(x, y, w, h)


def map_to_probe(a: Column, crop: Column, ref_w: Column, ref_h: Column) -> Column:
    """A box of the reference in a listing's own pixels: a scale for each axis and the crop's offset."""
    sx, sy = crop["w"] / ref_w, crop["h"] / ref_h
    return box(_whole(crop["x"] + a["x"] * sx), _whole(crop["y"] + a["y"] * sy), F.greatest(F.lit(1), _whole(a["w"] * sx)), F.greatest(F.lit(1), _whole(a["h"] * sy)))


def through(h: list[Column], a: Column, least: float = 2.0) -> Column:
    """Bounding box of a box's corners under a homography (nine numbers, by rows); null below `least` pixels."""
    corners = [(a["x"] + dx, a["y"] + dy) for dx in (F.lit(0), a["w"]) for dy in (F.lit(0), a["h"])]
    at = []
    for x, y in corners:
        z = h[6] * x + h[7] * y + h[8]
        at.append(((h[0] * x + h[1] * y + h[2]) / z, (h[3] * x + h[4] * y + h[5]) / z))
    x0, x1 = F.least(*[p[0] for p in at]), F.greatest(*[p[0] for p in at])
    y0, y1 = F.least(*[p[1] for p in at]), F.greatest(*[p[1] for p in at])
    return F.when((x1 - x0 >= least) & (y1 - y0 >= least), box(x0, y0, x1 - x0, y1 - y0))


def implied_scale(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.sqrt(F.abs(a * d - b * c))


def implied_rotation(a: Column, c: Column) -> Column:
    return F.degrees(F.atan2(c, a))


def corner_error(h: list[Column], true: list[Column], width: Column, height: Column) -> Column:
    """Mean distance of an image's corners through two homographies (nine numbers each, row by row)."""

    def place(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
        z = m[6] * x + m[7] * y + m[8]
        return (m[0] * x + m[1] * y + m[2]) / z, (m[3] * x + m[4] * y + m[5]) / z

    def apart(x: Column, y: Column) -> Column:
        (a, b), (c, d) = place(h, x, y), place(true, x, y)
        return F.sqrt((a - c) * (a - c) + (b - d) * (b - d))

    zero = F.lit(0.0)
    return (apart(zero, zero) + apart(width, zero) + apart(zero, height) + apart(width, height)) / 4
