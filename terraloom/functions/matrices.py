"""4x4 matrices as row-major arrays of 16 numbers, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def at(m: Column, i: int, j: int) -> Column:
    return F.get(m, F.lit(4 * i + j))


def identity() -> Column:
    return F.array(*map(F.lit, IDENTITY))


def composed(parent: Column, local: Column) -> Column:
    """parent * local."""
    return F.array(*(at(parent, i, 0) * at(local, 0, j) + at(parent, i, 1) * at(local, 1, j) + at(parent, i, 2) * at(local, 2, j) + at(parent, i, 3) * at(local, 3, j) for i in range(4) for j in range(4)))


def moved(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """A point by an affine matrix."""
    return [at(m, i, 0) * x + at(m, i, 1) * y + at(m, i, 2) * z + at(m, i, 3) for i in range(3)]


def turned(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """A direction by the upper 3x3 part."""
    return [at(m, i, 0) * x + at(m, i, 1) * y + at(m, i, 2) * z for i in range(3)]


def turned_back(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """A direction by the transpose of the upper 3x3 part: the inverse, for a rotation."""
    return [at(m, 0, i) * x + at(m, 1, i) * y + at(m, 2, i) * z for i in range(3)]


def rigid_inverse(m: Column) -> Column:
    """Inverse of a rotation with a translation."""
    t = turned_back(m, at(m, 0, 3), at(m, 1, 3), at(m, 2, 3))
    return F.array(*(x for i in range(3) for x in (at(m, 0, i), at(m, 1, i), at(m, 2, i), -t[i])), *map(F.lit, IDENTITY[12:]))


def normal_matrix(m: Column) -> Column:
    """Inverse transpose of the upper 3x3 part, 9 numbers by rows; null where it is singular."""

    def cofactor(i: int, j: int) -> Column:
        (a, b), (c, d) = (((i + 1) % 3, (i + 2) % 3), ((j + 1) % 3, (j + 2) % 3))
        return at(m, a, c) * at(m, b, d) - at(m, a, d) * at(m, b, c)

    det = at(m, 0, 0) * cofactor(0, 0) + at(m, 0, 1) * cofactor(0, 1) + at(m, 0, 2) * cofactor(0, 2)
    return F.when(det != 0, F.array(*(cofactor(i, j) / det for i in range(3) for j in range(3))))


def with_translation(m: Column, x: Column, y: Column, z: Column) -> Column:
    t = (x, y, z)
    return F.array(*(t[i] if j == 3 else at(m, i, j) for i in range(3) for j in range(4)), *(at(m, 3, j) for j in range(4)))
