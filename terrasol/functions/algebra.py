"""Map algebra: column expressions on one cell's bands.  Nothing here moves a row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasol.operators.grid import small


def ndvi(nir: Column, red: Column) -> Column:
    """(nir - red) / (nir + red); NULL where the sum is 0 or a band is missing."""
    return F.try_divide((nir - red).cast("double"), (nir + red).cast("double"))


def binarize(v: Column, threshold) -> Column:
    """1 from the threshold on, else 0; NULL stays."""
    return F.when(v >= threshold, 1).when(v.isNotNull(), 0)


def at_most(v: Column, limit) -> Column:
    """1 up to the limit, else 0; NULL stays."""
    return F.when(v <= limit, 1).when(v.isNotNull(), 0)


def thresholds(first: float = 0.20, last: float = 0.60, step: float = 0.05) -> list[float]:
    """Thresholds rounded to two decimals, so that 0.35 is 0.35."""
    return [round(first + i * step, 2) for i in range(int(round((last - first) / step)) + 1)]


def threshold_sweep(cells: DataFrame, band: str, values: list[float] | None = None) -> DataFrame:
    """One binary layer per threshold, named by its two decimals without the dot.  The thresholds are
    a literal array, exploded beside each row: no join."""
    pairs = F.array(*(F.struct(F.lit(f"terrasses_seuil_{t:.2f}".replace(".", "")).alias("label"), F.lit(t).alias("threshold")) for t in values or thresholds()))
    each = cells.select("row", "col", band, F.explode(pairs).alias("t"))
    return each.select("row", "col", F.col("t.label").alias("label"), binarize(F.col(band), F.col("t.threshold")).alias("value"))


def threshold_level(v: Column, values: list[float] | None = None) -> Column:
    """How many thresholds a value passes: the whole sweep in one column."""
    return F.when(v.isNotNull(), sum((F.when(v >= t, 1).otherwise(0) for t in values or thresholds()), F.lit(0)))


def reclass(cells: DataFrame, value: str, legend: DataFrame, unknown: int = 0) -> DataFrame:
    """Class of each value by the legend (broadcast if it is small, else an ordinary join); others are unknown."""
    known = small(legend.select(F.col("value").alias("_v"), "class_id"))
    return cells.join(known, F.col(value) == F.col("_v"), "left").withColumn("class_id", F.coalesce("class_id", F.lit(unknown))).drop("_v")


def minmax_scale(cells: DataFrame, bands: list[str]) -> DataFrame:
    """Each band to [0, 1] by its own least and greatest value; a constant band is only clipped."""
    stats = cells.agg(*(f(b).cast("double").alias(f"_{n}_{b}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))))
    out = cells.crossJoin(F.broadcast(stats))
    scaled = [
        F.when(F.col(b).isNull(), None)
        .otherwise(F.least(F.greatest(F.when(F.col(f"_hi_{b}") > F.col(f"_lo_{b}"), (F.col(b) - F.col(f"_lo_{b}")) / F.nullif(F.col(f"_hi_{b}") - F.col(f"_lo_{b}"), F.lit(0.0))).otherwise(F.col(b).cast("double")), F.lit(0.0)), F.lit(1.0)))
        .alias(b)
        for b in bands
    ]
    return out.select(*(c for c in cells.columns if c not in bands), *scaled)


def max_scale(cells: DataFrame, bands: list[str]) -> DataFrame:
    """All bands by the greatest value of any; NoData is 0, a greatest value of 0 or none counts as 1."""
    most = cells.agg(F.greatest(*(F.coalesce(F.max(b), F.lit(0)).cast("double") for b in bands), F.lit(0.0)).alias("_m")).select(F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0).alias("_m"))
    return cells.crossJoin(F.broadcast(most)).select(*(c for c in cells.columns if c not in bands), *((F.coalesce(F.col(b), F.lit(0)) / (F.col("_m") + 1e-8)).alias(b) for b in bands))


def argmax_class(probs: list[str], origin: int = 1, uncovered: int | None = None) -> Column:
    """Class with the greatest probability, the first of equals; `uncovered` where all are NULL."""
    best = F.greatest(*probs) if len(probs) > 1 else F.col(probs[0])
    pick = F.lit(None).cast("int")
    for k, p in reversed(list(enumerate(probs))):
        pick = F.when(F.col(p) == best, k + origin).otherwise(pick)
    return F.coalesce(pick, F.lit(uncovered)) if uncovered is not None else pick


def max_prob(probs: list[str]) -> Column:
    return F.greatest(*probs) if len(probs) > 1 else F.col(probs[0])


def value_to_null(v: Column, code) -> Column:
    return F.nullif(v, F.lit(code))


def diagnostics(convexity: Column, mean_slope: Column, slope_p10: Column) -> list[Column]:
    """Flags 0/1 of a patch: nearly convex, flat on average, flat tenth; a missing convexity is 0, missing slopes are 1."""
    flag = lambda c, none: F.when(c.isNull(), none)
    return [
        flag(convexity, 0).when(convexity >= 0.99, 1).otherwise(0).alias("diag_convexite"),
        flag(mean_slope, 1).when(mean_slope < 7.5, 1).otherwise(0).alias("diag_pente_moy"),
        flag(slope_p10, 1).when(slope_p10 < 45, 1).otherwise(0).alias("diag_pente_dec10"),
    ]


def patch_name(number: Column, kind: str = "i", offset: int = 725) -> Column:
    return F.format_string(f"2_%d_{kind}.tif", number + offset)


def window_name(image: Column, i: Column, j: Column) -> Column:
    return F.format_string("patch_proba_img%d_i%d_j%d.tif", image, i, j)


def scenario_name(low: Column, steep: Column) -> Column:
    return F.concat_ws("_", low.cast("int"), steep.cast("int"))


# GRS80 ellipsoid and the Lambert-93 cone (two standard parallels, origin 46.5 N 3 E).
A, FLAT = 6378137.0, 1 / 298.257222101
E2 = FLAT * (2 - FLAT)
ECC = math.sqrt(E2)
PHI1, PHI2, PHI0, LAM0 = (math.radians(v) for v in (44.0, 49.0, 46.5, 3.0))
X0, Y0 = 700000.0, 6600000.0


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)


def _t(phi: float) -> float:
    return math.tan(math.pi / 4 - phi / 2) / ((1 - ECC * math.sin(phi)) / (1 + ECC * math.sin(phi))) ** (ECC / 2)


CONE = (math.log(_m(PHI1)) - math.log(_m(PHI2))) / (math.log(_t(PHI1)) - math.log(_t(PHI2)))
RADIUS = A * _m(PHI1) / (CONE * _t(PHI1) ** CONE)
RHO0 = RADIUS * _t(PHI0) ** CONE


def to_lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north of degrees, by column math."""
    phi = F.radians(lat)
    s = F.sin(phi) * ECC
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(ECC / 2))
    rho, theta = F.pow(t, F.lit(CONE)) * RADIUS, (F.radians(lon) - LAM0) * CONE
    return rho * F.sin(theta) + X0, F.lit(RHO0 + Y0) - rho * F.cos(theta)


def to_wgs84(x: Column, y: Column, rounds: int = 6) -> tuple[Column, Column]:
    """Degrees of Lambert-93 metres; a fixed number of rounds gives the latitude to 1e-12."""
    dx, dy = x - X0, F.lit(RHO0 + Y0) - y
    t = F.pow(F.sqrt(dx * dx + dy * dy) / RADIUS, F.lit(1 / CONE))
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(rounds):
        s = F.sin(phi) * ECC
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(ECC / 2)))
    return F.degrees(F.atan2(dx, dy) / CONE + LAM0), F.degrees(phi)
