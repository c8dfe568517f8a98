"""Geometry as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def footpoint(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Where a box stands: middle of its lower edge."""
    return x + w / 2, y + h


def project(x: Column, y: Column, h: Sequence[Column | float], strict: bool = False) -> tuple[Column, Column]:
    """(x, y) through a row-major 3x3 homography; null where the point goes to infinity, or, strictly, an error."""
    w = h[6] * x + h[7] * y + h[8]
    if strict:
        w = F.when(F.abs(w) < 1e-12, F.raise_error(F.lit("a projected point lies at infinity")).cast("double")).otherwise(w)
    else:
        w = F.when(F.abs(w) >= 1e-9, w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def inside(x: Column, y: Column, bounds: tuple[float, float, float, float], margin: float = 0.0) -> Column:
    """Within (x_min, x_max, y_min, y_max) widened by the margin, edges included."""
    return x.between(bounds[0] - margin, bounds[1] + margin) & y.between(bounds[2] - margin, bounds[3] + margin)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def in_polygon(x: Column, y: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's edges."""
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]]):
        if ay == by:
            continue
        crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < F.lit(bx - ax) * (y - ay) / (by - ay) + ax)
        odd = odd != crosses
    return odd


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def clock(seconds: Column) -> Column:
    """MM:SS.mmm"""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))
