"""Plane geometry as column expressions. Rectangles are columns x, y, w, h; polygons are arrays of struct<x, y>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: str, b: str, strict: bool = True) -> Column:
    """Do rectangles of aliases a and b overlap? Touching counts only where strict is False."""
    c = lambda t, n: F.col(f"{t}.{n}")
    less = (lambda p, q: p < q) if strict else (lambda p, q: p <= q)
    return less(c(a, "x"), c(b, "x") + c(b, "w")) & less(c(b, "x"), c(a, "x") + c(a, "w")) & less(c(a, "y"), c(b, "y") + c(b, "h")) & less(c(b, "y"), c(a, "y") + c(a, "h"))


def overlap_area(a: str, b: str) -> Column:
    c = lambda t, n: F.col(f"{t}.{n}")
    side = lambda p, s: F.greatest(F.lit(0), F.least(c(a, p) + c(a, s), c(b, p) + c(b, s)) - F.greatest(c(a, p), c(b, p)))
    return side("x", "w") * side("y", "h")


def gap_squared(a: str, b: str) -> Column:
    """Squared distance of two rectangles, 0 where they touch."""
    c = lambda t, n: F.col(f"{t}.{n}")
    apart = lambda p, s: F.greatest(F.lit(0), c(a, p) - c(b, p) - c(b, s), c(b, p) - c(a, p) - c(a, s)).cast("double")
    return apart("x", "w") * apart("x", "w") + apart("y", "h") * apart("y", "h")


def ring(polygon: Column) -> Column:
    """Edges of a closed ring: array of struct<p, q>."""
    following = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def signed_area(polygon: Column) -> Column:
    """Shoelace formula: positive counter-clockwise; fewer than three points: 0."""
    cross = F.aggregate(ring(polygon), F.lit(0.0), lambda s, e: s + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]).cast("double"))
    return F.when(F.size(polygon) >= 3, cross / 2).otherwise(0.0)


def perimeter(polygon: Column) -> Column:
    side = lambda e: F.sqrt(F.pow(e["q"]["x"] - e["p"]["x"], 2) + F.pow(e["q"]["y"] - e["p"]["y"], 2))
    return F.when(F.size(polygon) >= 2, F.aggregate(ring(polygon), F.lit(0.0), lambda s, e: s + side(e))).otherwise(0.0)


def centroid(polygon: Column) -> Column:
    """struct(x, y): weighted by area; a degenerate ring has the mean of its points."""
    area = signed_area(polygon)
    part = lambda k: F.aggregate(ring(polygon), F.lit(0.0), lambda s, e: s + (e["p"][k] + e["q"][k]).cast("double") * (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]).cast("double"))
    mean = lambda k: F.aggregate(polygon, F.lit(0.0), lambda s, p: s + p[k].cast("double")) / F.size(polygon)
    return F.struct(*(F.when(F.abs(area) < 1e-9, mean(k)).otherwise(part(k) / (6 * area)).alias(k) for k in ("x", "y")))


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Point in polygon by ray casting with the half-open rule."""
    crosses = lambda e: (((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0)) + e["p"]["x"]))
    return F.aggregate(ring(polygon), F.lit(False), lambda s, e: s != F.coalesce(crosses(e), F.lit(False)))


def point_segment_squared(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0)), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.pow(px - x1 - t * dx, 2) + F.pow(py - y1 - t * dy, 2)


def point_polygon_squared(px: Column, py: Column, polygon: Column) -> Column:
    """Squared distance of a point from the nearest edge of a closed ring, also from inside; null under three points."""
    edges = F.transform(ring(polygon), lambda e: point_segment_squared(px, py, e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]))
    return F.when(F.size(polygon) >= 3, F.array_min(edges))


def _turns(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """Does a, b, c turn counter-clockwise?"""
    return (c[1] - a[1]) * (b[0] - a[0]) > (b[1] - a[1]) * (c[0] - a[0])


def segments_cross(p: tuple[Column, Column], q: tuple[Column, Column], r: tuple[Column, Column], s: tuple[Column, Column]) -> Column:
    """Do the segments p-q and r-s cross? Each has the other's ends on different sides."""
    return (_turns(p, r, s) != _turns(q, r, s)) & (_turns(p, q, r) != _turns(p, q, s))


def crossing(p: tuple[Column, Column], q: tuple[Column, Column], r: tuple[Column, Column], s: tuple[Column, Column]) -> Column:
    """struct(x, y, inner) of the point that two segments share, ends included; null for parallel ones and those that don't meet.
    inner: the point is away from all four ends, between 1 % and 99 % of both segments."""
    d = ((p[0] - q[0]) * (r[1] - s[1]) - (p[1] - q[1]) * (r[0] - s[0])).cast("double")
    safe = F.when(F.abs(d) >= 1e-10, d)
    t = ((p[0] - r[0]) * (r[1] - s[1]) - (p[1] - r[1]) * (r[0] - s[0])) / safe
    u = -((p[0] - q[0]) * (p[1] - r[1]) - (p[1] - q[1]) * (p[0] - r[0])) / safe
    inner = (t > 0.01) & (t < 0.99) & (u > 0.01) & (u < 0.99)
    return F.when(t.between(0, 1) & u.between(0, 1), F.struct((p[0] + t * (q[0] - p[0])).alias("x"), (p[1] + t * (q[1] - p[1])).alias("y"), inner.alias("inner")))


def rectangle_meets(x: Column, y: Column, w: Column, h: Column, polygon: Column) -> Column:
    """Does a rectangle meet a polygon? A corner lies in the polygon, a vertex in the rectangle, or edges cross. False under three
    points."""
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    test = F.exists(polygon, lambda v: v["x"].between(x, x + w) & v["y"].between(y, y + h))
    for i, corner in enumerate(corners):
        after = corners[(i + 1) % 4]
        side = lambda c, d: lambda e: segments_cross((e["p"]["x"], e["p"]["y"]), (e["q"]["x"], e["q"]["y"]), c, d)
        test = test | inside(*corner, polygon) | F.exists(ring(polygon), side(corner, after))
    return F.coalesce((F.size(polygon) >= 3) & test, F.lit(False))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row: an expression named several times, or inside a lambda, is else computed each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def seldom(test: Column) -> Column:
    """A long test for the few rows that pass the short ones before it. Bound by `once` it stays out of the loop that Spark generates for a
    join, which the JVM compiles only while it is short."""
    return once(F.lit(0), lambda _: test)


def cleaned(polygon: Column, tolerance: float) -> Column:
    """A ring of doubles without null points, without points within tolerance of the last one kept (the end counts against the start),
    and without points on a straight line, if three are left without those."""
    far = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)) > tolerance
    bend = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"])

    def apart(known):
        return F.aggregate(known, F.slice(known, 1, 0), lambda a, p: F.when((F.size(a) == 0) | far(F.element_at(a, -1), p), F.concat(a, F.array(p))).otherwise(a))

    def closed(kept):
        return F.when((F.size(kept) > 1) & ~far(F.get(kept, F.lit(0)), F.element_at(kept, -1)), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)

    def straightened(kept):
        n = F.size(kept)
        at = lambda i: F.get(kept, F.pmod(i, n))
        bent = F.filter(kept, lambda p, i: F.abs(bend(at(i - 1), p, at(i + 1))) > tolerance * tolerance)
        return once(bent, lambda b: F.when((n >= 3) & (F.size(b) >= 3), b).otherwise(kept))

    known = F.filter(polygon, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())
    return once(known, lambda k: once(apart(k), lambda a: once(closed(a), straightened)))


def ring_key(polygon: Column, places: int = 4) -> Column:
    """One text for all rotations and both directions of a ring: the least of them, coordinates rounded."""
    near = F.transform(polygon, lambda p: F.struct(F.round(p["x"], places).alias("x"), F.round(p["y"], places).alias("y")))

    def turned(r):
        n = F.size(r)
        whole = lambda low: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.get(r, k) == low), lambda k: F.concat(F.slice(r, k + 1, n - k), F.slice(r, 1, k)))
        return once(F.array_min(r), whole)  # the least one begins with the least point

    said = lambda r: F.array_join(F.transform(r, lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))), ";")
    least = lambda r: F.array_min(F.concat(turned(r), once(F.reverse(r), turned)))
    return once(near, lambda r: F.when(F.size(r) > 0, said(least(r))))
