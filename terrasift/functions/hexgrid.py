"""A lattice of regular hexagons on a local plane, as Column expressions.

A cell has axial coordinates q and r, packed into one BIGINT. The lattice gives
what a global hexagon index gives a city, but its ids are its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo

_HALF, _STEP = 1 << 20, 1 << 21
#: The centre's six neighbours, in order of their angle.
RING = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))


@dataclass(frozen=True)
class Lattice:
    """origin: (latitude, longitude) of the plane; edge: a cell's side in km."""

    origin: tuple[float, float]
    edge: float = 0.461

    @property
    def cell_area(self) -> float:
        return 3 * math.sqrt(3) / 2 * self.edge**2

    def cell_xy(self, x: Column, y: Column) -> Column:
        """The cell of a point of the plane."""
        q = (math.sqrt(3) / 3 * x - y / 3) / self.edge
        r = (y * 2 / 3) / self.edge
        return pack(*rounded(q, r))

    def cell(self, lat: Column, lng: Column) -> Column:
        return self.cell_xy(geo.east_km(lng, self.origin), geo.north_km(lat, self.origin))

    def x(self, cell: Column) -> Column:
        return self.edge * (math.sqrt(3) * q_of(cell) + math.sqrt(3) / 2 * r_of(cell))

    def y(self, cell: Column) -> Column:
        return self.edge * (F.lit(1.5) * r_of(cell))

    def lat(self, cell: Column) -> Column:
        return geo.lat_of(self.y(cell), self.origin)

    def lng(self, cell: Column) -> Column:
        return geo.lng_of(self.x(cell), self.origin)

    def ring(self, cell: Column) -> Column:
        """The six corners (x, y), turning left."""
        x, y = self.x(cell), self.y(cell)
        at = [(self.edge * math.cos(a), self.edge * math.sin(a)) for a in (math.radians(60 * k - 30) for k in range(6))]
        return F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in at))


def pack(q: Column, r: Column) -> Column:
    return (q.cast("long") + _HALF) * _STEP + (r.cast("long") + _HALF)


def q_of(cell: Column) -> Column:
    return F.shiftright(cell, 21) - _HALF


def r_of(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(_STEP - 1)) - _HALF


def rounded(q: Column, r: Column) -> tuple[Column, Column]:
    """The hexagon that fractional axial coordinates lie in."""
    return _settled(q, r, *_nearest(q, r))


def _nearest(q: Column, r: Column) -> list[Column]:
    return [F.floor(v + 0.5) for v in (q, r, -q - r)]


def _settled(q: Column, r: Column, a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Of three rounded coordinates the one that moved most follows from the others."""
    da, db, dc = F.abs(a - q), F.abs(b - r), F.abs(c - (-q - r))
    return F.when((da > db) & (da > dc), -b - c).otherwise(a), F.when((da > db) & (da > dc), b).when(db > dc, -a - c).otherwise(b)


def offsets(k: int) -> list[tuple[int, int]]:
    """(dq, dr) of all cells within k steps, the centre included."""
    return [(q, r) for q in range(-k, k + 1) for r in range(max(-k, -q - k), min(k, -q + k) + 1)]


def disk(cell: Column, k: int = 1) -> Column:
    """The cells within k steps, the cell itself included. The transform takes the cell's
    own expression, which may be long, once."""
    return F.element_at(F.transform(F.array(cell), lambda c: F.array(*(c + (q * _STEP + r) for q, r in offsets(k)))), 1)


def steps(a: Column, b: Column) -> Column:
    """Steps between two cells."""
    dq, dr = q_of(a) - q_of(b), r_of(a) - r_of(b)
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("int")


def path(a: Column, b: Column) -> Column:
    """The cells of the straight line from a to b, both included. Points on a border
    are nudged one way, so the way back may differ.

    Each transform hands on what later ones need several times, so that the expression
    stays small: written out, it is thousands of nodes, slow to plan and compile."""
    nudge_q, nudge_r = 1e-6, 2e-6
    ends = F.struct((q_of(a) + nudge_q).alias("q"), (r_of(a) + nudge_r).alias("r"), (q_of(b) - q_of(a)).alias("dq"), (r_of(b) - r_of(a)).alias("dr"), steps(a, b).alias("n"))

    def point(e: Column, i: Column) -> Column:
        t = F.when(e["n"] > 0, i / e["n"]).otherwise(0.0)
        return F.struct((e["q"] + e["dq"] * t).alias("q"), (e["r"] + e["dr"] * t).alias("r"))

    points = F.element_at(F.transform(F.array(ends), lambda e: F.transform(F.sequence(F.lit(0), e["n"]), lambda i: point(e, i))), 1)
    near = F.transform(points, lambda p: F.struct(p["q"].alias("q"), p["r"].alias("r"), *(v.alias(n) for n, v in zip("abc", _nearest(p["q"], p["r"]), strict=True))))
    return F.transform(near, lambda p: pack(*_settled(*(p[n] for n in ("q", "r", "a", "b", "c")))))
