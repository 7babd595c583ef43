"""Axis conventions, stated once.

``y_up`` is (east, up, south); ``enu`` is (east, north, up); ``z_up`` is the plain swap
of the last two axes of ``y_up``, without a change of sign, so that z_up to enu negates
north.  Projected coordinates swap as z_up does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def _to_y_up(v: Vector, frame: str) -> Vector:
    x, y, z = v
    return {"y_up": (x, y, z), "enu": (x, z, -y), "tiles_z_up": (x, z, -y), "z_up": (x, z, y), "projected": (x, z, y)}[frame]


def _from_y_up(v: Vector, frame: str) -> Vector:
    x, y, z = v
    return {"y_up": (x, y, z), "enu": (x, -z, y), "tiles_z_up": (x, -z, y), "z_up": (x, z, y), "projected": (x, z, y)}[frame]


def convert(v: Vector, source: str, target: str) -> Vector:
    """A point or a normal from one frame to another; geographic and ECEF vectors pass unchanged."""
    if source in ("geographic", "ecef") or target in ("geographic", "ecef"):
        return v
    return _from_y_up(_to_y_up(v, source), target)


def convert_box(low: Vector, high: Vector, source: str, target: str) -> tuple[Vector, Vector]:
    """A box through its eight corners."""
    pick = lambda k, i: (high if k >> i & 1 else low)[i]
    corners = [convert((pick(k, 0), pick(k, 1), pick(k, 2)), source, target) for k in range(8)]
    return tuple(F.least(*(c[i] for c in corners)) for i in range(3)), tuple(F.greatest(*(c[i] for c in corners)) for i in range(3))
