"""Bounding spheres."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from terraloom.operators import mesh


def test_sphere_in_any_order(spark):
    """The centre is the mean, rounded once: on a half of a unit it does not turn with the order of the rows."""
    rng = np.random.default_rng(3)
    rows = [(m, float(x), -float(x) / 3, float(x) * 1e-6) for m in range(40) for x in rng.integers(90_000, 10_500_000, 30) / 500.0 + 1e6 * (m % 2)]
    want = {m: [float(sum(Fraction(r[k]) for r in rows if r[0] == m) / 30) for k in (1, 2)] for m in range(40)}
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1])):
        got = mesh.bounding_sphere(spark.createDataFrame(order, "mesh long, x double, y double, z double").repartition(3), ["mesh"]).collect()
        assert {r["mesh"]: [r["cx"], r["cy"]] for r in got} == want


def test_exact_mean_of_odd_values(spark):
    rows = [(0, 1e300), (0, 1e300), (1, math.nan), (1, 1.0), (2, None), (3, -0.3), (3, None), (3, -0.1), (4, float(1 << 38)), (4, 2.0**-14)]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(mesh.exact_mean(F.col("x")).alias("m")).collect()}
    assert got[0] == 1e300 and math.isnan(got[1]) and got[2] is None and abs(got[3] + 0.2) < 1e-15 and got[4] == float(1 << 37) + 2.0**-15
