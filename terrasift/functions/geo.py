"""Column functions on coordinates. Shapes are arrays of points, in order.

Metric work is done on a local plane: kilometres east and north of an origin, with
the origin's latitude fixing the scale of the east axis. Over a city the error
stays below a thousandth.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the mean radius of the earth.
EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def east_km(lng: Column, origin: tuple[float, float]) -> Column:
    """origin: (latitude, longitude) of the plane."""
    return (lng - origin[1]) * (EARTH_KM * math.cos(math.radians(origin[0])) * math.pi / 180)


def north_km(lat: Column, origin: tuple[float, float]) -> Column:
    return (lat - origin[0]) * (EARTH_KM * math.pi / 180)


def lng_of(east: Column, origin: tuple[float, float]) -> Column:
    return east / (EARTH_KM * math.cos(math.radians(origin[0])) * math.pi / 180) + origin[1]


def lat_of(north: Column, origin: tuple[float, float]) -> Column:
    return north / (EARTH_KM * math.pi / 180) + origin[0]


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def point_segment_km(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment, which may have no length."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / square))).otherwise(0.0)
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def edges(ring: Column) -> Column:
    """(x1, y1, x2, y2) of a ring's sides; the last point joins the first."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring of (x, y), by the crossings of a ray."""

    def cross(inside: Column, e: Column) -> Column:
        spans = (e["y1"] > py) != (e["y2"] > py)
        at = e["x1"] + F.try_divide((py - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return F.when(spans & (px < at), ~inside).otherwise(inside)

    return F.aggregate(edges(ring), F.lit(False), cross)


def in_rings(px: Column, py: Column, rings: Column) -> Column:
    """Inside an odd number of rings: a polygon with holes, or several that are apart."""
    return F.aggregate(rings, F.lit(False), lambda inside, ring: inside != in_ring(px, py, ring))


def ring_area(ring: Column) -> Column:
    """Area of a ring of (x, y), whichever way it turns."""
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def ring_centroid(ring: Column) -> Column:
    """Area centroid (x, y) of a ring; the mean of its points where it has no area."""
    twice = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])

    def moment(a: str, b: str) -> Column:
        return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e[a] + e[b]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"]))

    mean = vertex_mean(ring)
    put = lambda m, c: F.coalesce(F.try_divide(m, F.nullif(3 * twice, F.lit(0.0))), mean[c])
    return F.struct(put(moment("x1", "x2"), "x").alias("x"), put(moment("y1", "y2"), "y").alias("y"))


def vertex_mean(ring: Column) -> Column:
    """Mean (x, y) of a ring's points, a closing point included."""
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def clipped_length(x1: Column, y1: Column, x2: Column, y2: Column, ring: Column) -> Column:
    """Length of the part of a segment inside a convex ring that turns left. A
    segment along a shared border counts on both sides."""
    dx, dy = x2 - x1, y2 - y1
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def cut(s: Column, e: Column) -> Column:
        # Inside is left of each side: the cross product is not negative.
        ex, ey = e["x2"] - e["x1"], e["y2"] - e["y1"]
        at = ex * (y1 - e["y1"]) - ey * (x1 - e["x1"])
        by = ex * dy - ey * dx
        t = F.try_divide(-at, by)
        lo = F.when(by > 0, F.greatest(s["lo"], t)).when((by == 0) & (at < 0), F.lit(2.0)).otherwise(s["lo"])
        hi = F.when(by < 0, F.least(s["hi"], t)).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    part = F.aggregate(edges(ring), start, cut, lambda s: F.greatest(F.lit(0.0), s["hi"] - s["lo"]))
    return part * F.sqrt(dx * dx + dy * dy)


def ring_distance(px: Column, py: Column, ring: Column) -> Column:
    """Distance of a point from a filled ring: 0 inside."""
    near = F.array_min(F.transform(edges(ring), lambda e: point_segment_km(px, py, e["x1"], e["y1"], e["x2"], e["y2"])))
    return F.when(in_ring(px, py, ring), 0.0).otherwise(near)


def literal_ring(points: list[tuple[float, float]]) -> Column:
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))
