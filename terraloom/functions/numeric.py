"""Rounding and packing that give the same integers on any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised(x: Column, scale: float = 1e3) -> Column:
    """Nearest whole number of ``1 / scale`` units, halves upwards."""
    return F.floor(x * F.lit(float(scale)) + F.lit(0.5)).cast("long")


def zigzag(d: Column) -> Column:
    """Signed to unsigned in 16 bits: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 31)).bitwiseAND(F.lit(0xFFFF))


def packed_cell_key(level: Column, ix: Column, iy: Column, iz: Column) -> Column:
    """Level in 5 bits and three 16-bit indexes in one 64-bit key; indexes wrap beyond 16 bits."""
    part = lambda c, shift: F.shiftleft(c.cast("long").bitwiseAND(F.lit(0xFFFF)), shift)
    return F.shiftleft(level.cast("long").bitwiseAND(F.lit(31)), 48).bitwiseOR(part(ix, 32)).bitwiseOR(part(iy, 16)).bitwiseOR(part(iz, 0))


def octant(x: Column, y: Column, z: Column) -> Column:
    """Child index within the parent cell from the low bits of the child's indexes."""
    bit = lambda c, n: F.shiftleft(c.bitwiseAND(F.lit(1)), n)
    return bit(x, 0).bitwiseOR(bit(y, 1)).bitwiseOR(bit(z, 2)).cast("int")
