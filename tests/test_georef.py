"""Control-point fits over more points than the driver would hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import georef


def test_affine_fit_uses_all_points(spark):
    k = F.col("id")
    rows = spark.range(20_500).repartition(5).select(
        (k % 131 * 10 + 4.0e5).alias("sx"), (k % 57 * 20 + 5.0e6).alias("sy"), (k % 7 + 30.0).alias("sz"), (k % 131 * 3.0 + F.when(k < 10_000, 0.0).otherwise(8.0)).alias("tx"), (k % 57 * 2.0 - k * 0.001).alias("ty"), (k % 7 * 1.5).alias("tz")
    )
    a = np.array(rows.collect(), float)
    mid, out = a[:, :3].mean(0), a[:, 3:].mean(0)
    m = np.linalg.lstsq(a[:, :3] - mid, a[:, 3:] - out, rcond=None)[0]
    got = georef.fit_affine(rows)
    assert np.allclose(got[:3], m, rtol=1e-7, atol=1e-9)
    assert np.allclose(a[:, :3] @ got[:3] + got[3], (a[:, :3] - mid) @ m + out, atol=1e-6)
    with pytest.raises(ValueError):
        georef.fit_affine(rows.limit(3))


def test_affine_fit_of_constant_heights(spark):
    rows = spark.range(50).select(F.col("id").alias("sx"), (F.col("id") % 7).alias("sy"), F.lit(1234.567).alias("sz"), (F.col("id") * 2.0 + 1).alias("tx"), (F.col("id") % 7 * 3.0).alias("ty"), F.lit(9.5).alias("tz"))
    assert np.allclose(georef.fit_affine(rows), [[2, 0, 0], [0, 3, 0], [0, 0, 0], [1, 0, 9.5]], atol=1e-9)
