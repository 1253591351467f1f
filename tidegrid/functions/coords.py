"""Coordinates: degree-minute text, equal-area projection, grid cells.

The projection is the ellipsoidal Albers equal-area conic in closed form.  Its constants are
driver-side floats, so projecting a row is one codegen'd expression and no UDF.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from tidegrid.functions.missing import as_col


def degrees_minutes(deg: Column | str, minutes: Column | str) -> Column:
    return as_col(deg) + as_col(minutes) / 60.0


def parse_degrees_minutes(text: Column | str) -> Column:
    """Unsigned decimal degrees of text such as ``48 7.3`` or ``-123 11.2``.

    The text splits on runs of non-alphanumerics, so a leading sign leaves an empty first
    piece; the caller applies the sign.  NULL when the text holds no degree-minute pair.
    """
    parts = F.filter(F.split(as_col(text), "[^0-9A-Za-z]+"), lambda p: p != "")
    piece = lambda i: F.get(parts, F.lit(i))
    minutes = F.concat(piece(1), F.lit("."), piece(2))
    return piece(0).try_cast("double") + minutes.try_cast("double") / 60.0


@dataclass(frozen=True)
class Albers:
    """Albers equal-area conic on an ellipsoid (defaults: EPSG:3005 on GRS80)."""

    a: float = 6378137.0
    inv_f: float = 298.257222101
    lat1: float = 50.0
    lat2: float = 58.5
    lat0: float = 45.0
    lon0: float = -126.0
    x0: float = 1000000.0
    y0: float = 0.0
    e2: float = field(init=False)
    e: float = field(init=False)
    n: float = field(init=False)
    c: float = field(init=False)
    rho0: float = field(init=False)

    def __post_init__(self) -> None:
        f = 1.0 / self.inv_f
        e2 = 2 * f - f * f
        e = math.sqrt(e2)

        def m(deg: float) -> float:
            s = math.sin(math.radians(deg))
            return math.cos(math.radians(deg)) / math.sqrt(1 - e2 * s * s)

        def q(deg: float) -> float:
            s = math.sin(math.radians(deg))
            return (1 - e2) * (
                s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e)
            )

        n = (m(self.lat1) ** 2 - m(self.lat2) ** 2) / (q(self.lat2) - q(self.lat1))
        c = m(self.lat1) ** 2 + n * q(self.lat1)
        rho0 = self.a * math.sqrt(c - n * q(self.lat0)) / n
        for name, value in (("e2", e2), ("e", e), ("n", n), ("c", c), ("rho0", rho0)):
            object.__setattr__(self, name, value)

    def xy(self, lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
        s = F.sin(F.radians(as_col(lat)))
        es = s * self.e
        q = (s / (1.0 - s * s * self.e2) - F.log((1.0 - es) / (1.0 + es)) / (2 * self.e)) * (
            1 - self.e2
        )
        rho = F.sqrt(self.c - q * self.n) * (self.a / self.n)
        theta = F.radians(as_col(lon) - self.lon0) * self.n
        return rho * F.sin(theta) + self.x0, self.rho0 - rho * F.cos(theta) + self.y0


@dataclass(frozen=True)
class GridSpec:
    """Origin of a regular square grid.  Cells are integer keys and never materialised."""

    xmin: float = 0.0
    ymin: float = 0.0

    def index(self, x: Column | str, y: Column | str, size: float | Column) -> tuple[Column, Column]:
        """Half-open cell index of a point."""
        return (
            F.floor((as_col(x) - self.xmin) / size).cast("long"),
            F.floor((as_col(y) - self.ymin) / size).cast("long"),
        )

    def cells(self, x: Column | str, y: Column | str, size: float | Column) -> Column:
        """Array of (ix, iy) whose closed squares touch the point: 1, 2 or 4 cells."""
        qx = (as_col(x) - self.xmin) / size
        qy = (as_col(y) - self.ymin) / size
        ix, iy = F.floor(qx).cast("long"), F.floor(qy).cast("long")
        cell = lambda i, j: F.struct(i.alias("ix"), j.alias("iy"))
        on_x, on_y = qx == F.floor(qx), qy == F.floor(qy)
        return (
            F.when(on_x & on_y, F.array(cell(ix, iy), cell(ix - 1, iy), cell(ix, iy - 1), cell(ix - 1, iy - 1)))
            .when(on_x, F.array(cell(ix, iy), cell(ix - 1, iy)))
            .when(on_y, F.array(cell(ix, iy), cell(ix, iy - 1)))
            .otherwise(F.array(cell(ix, iy)))
        )
