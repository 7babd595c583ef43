"""Control-point fits and candidate coordinate systems."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_POINTS = 10_000


def basis(order: int) -> list[tuple[int, int]]:
    """Exponents of x and y of a polynomial: 3, 6 or 10 terms for orders 1 to 3."""
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    return [(c.count("x"), c.count("y")) for k in range(order + 1) for c in combinations_with_replacement("xy", k)]


def fit_polynomial(points: DataFrame, order: int = 1) -> dict[str, list[float]]:
    """Least squares of lon and lat on the basis of (sx, sy), and of h on 1, sx, sy, sz.

    The points are a short list that people measure; their number is checked.  Shifted and
    scaled to the unit box, the system is solved by SVD, so constant heights do no harm.
    """
    rows = points.select("sx", "sy", "sz", "tx", "ty", "tz").limit(MOST_POINTS + 1).collect()
    if len(rows) > MOST_POINTS:
        raise ValueError("too many control points")
    terms = basis(order)
    if len(rows) < -(-(2 * len(terms) + 4) // 3):
        raise ValueError("too few control points")
    a = np.array(rows, float)
    mid, span = a[:, :3].mean(0), np.maximum(np.ptp(a[:, :3], axis=0), 1e-9)
    x, y, z = ((a[:, :3] - mid) / span).T
    plane = np.stack([x**i * y**j for i, j in terms], 1)
    space = np.stack([np.ones_like(x), x, y, z], 1)
    solve = lambda m, t: np.linalg.lstsq(m, t, rcond=None)[0]
    lon, lat, h = solve(plane, a[:, 3]), solve(plane, a[:, 4]), solve(space, a[:, 5])
    left = np.stack([plane @ lon - a[:, 3], plane @ lat - a[:, 4], space @ h - a[:, 5]])
    return {"mid": mid.tolist(), "span": span.tolist(), "lon": lon.tolist(), "lat": lat.tolist(), "h": h.tolist(), "rms": np.sqrt((left**2).mean(1)).tolist(), "order": order}


def apply_polynomial(df: DataFrame, fit: dict) -> DataFrame:
    """Adds lon, lat, alt of columns sx, sy, sz."""
    x, y, z = ((F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(("sx", "sy", "sz"), fit["mid"], fit["span"], strict=True))
    power = lambda c, k: F.lit(1.0) if k == 0 else (c if k == 1 else c * power(c, k - 1))
    plane = lambda w: sum((F.lit(v) * power(x, i) * power(y, j) for v, (i, j) in zip(w, basis(fit["order"]), strict=True)), F.lit(0.0))
    h = fit["h"]
    return df.withColumns({"lon": plane(fit["lon"]), "lat": plane(fit["lat"]), "alt": F.lit(h[0]) + F.lit(h[1]) * x + F.lit(h[2]) * y + F.lit(h[3]) * z})


def fit_affine(points: DataFrame) -> np.ndarray:
    """4 x 3 matrix of the least-squares affine map of (sx, sy, sz) to (tx, ty, tz) over all points; at least four.

    The points stay where they are: one aggregation gives means and spans, a second the sums
    of products about the means, in units of the spans, so that large coordinates keep their digits.
    """
    names = ("sx", "sy", "sz", "tx", "ty", "tz")
    points = points.select(*(F.col(c).cast("double").alias(c) for c in names))
    n, *stats = points.agg(F.count("*"), *(F.avg(c) for c in names), *(F.max(c) - F.min(c) for c in names)).first()
    if n < 4:
        raise ValueError("too few control points")
    if None in stats or points.where(" OR ".join(f"{c} IS NULL" for c in names)).limit(1).count():
        raise ValueError("control points with a null coordinate")
    mid, span = np.array(stats[:6]), np.array([w or 1.0 for w in stats[6:]])
    z = [(F.col(c) - F.lit(float(m))) / F.lit(float(w)) for c, m, w in zip(names, mid, span, strict=True)]
    sums = points.agg(*(F.sum(z[i] * z[j]) for i in range(3) for j in range(6)), *(F.sum(x) for x in z)).first()
    a, rest = np.array(sums[:18], float).reshape(3, 6), np.array(sums[18:], float)
    # What rounding left of the means.
    a -= np.outer(rest[:3], rest) / n
    # A direction without extent counts for nothing, as in the fit by SVD of the points themselves.
    m = np.linalg.lstsq(a[:, :3], a[:, 3:], rcond=1e-12)[0] * span[3:] / span[:3, None]
    return np.vstack([m, mid[3:] - mid[:3] @ m])


def utm_candidates(lon: float, lat: float, spread: int = 2) -> list[tuple[str, float]]:
    """Codes and central meridians of the UTM zones around a longitude; both hemispheres near the equator."""
    zone = min(max(int((lon + 180) // 6) + 1, 1), 60)
    halves = (326, 327) if abs(lat) < 1 else ((326,) if lat >= 0 else (327,))
    zones = [(zone - 1 + k) % 60 + 1 for k in range(-spread, spread + 1)]
    return [(f"EPSG:{half}{z:02d}", z * 6 - 183.0) for half in halves for z in zones]


def ranked_candidates(evaluated: DataFrame, top: int = 5, least: int = 3) -> DataFrame:
    """(candidate, n, rms) by ascending error in degrees; ``evaluated`` has candidate, lon, lat, tlon, tlat.

    Differences of longitude wrap at 180 degrees.
    """
    dlon = F.pmod(F.col("lon") - F.col("tlon") + 180.0, F.lit(360.0)) - 180.0
    dlat = F.col("lat") - F.col("tlat")
    rms = F.sqrt(F.avg(dlon * dlon + dlat * dlat))
    return evaluated.groupBy("candidate").agg(F.count("*").alias("n"), rms.alias("rms")).where(F.col("n") >= least).orderBy("rms", "candidate").limit(top)
