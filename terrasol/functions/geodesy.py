"""Areas on the ellipsoid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasol.functions.algebra import E2, ECC, A

# Places and weights of the five-point Gauss-Legendre rule on [-1, 1].
GAUSS = ((0.0, 128 / 225), (-math.sqrt(5 - 2 * math.sqrt(10 / 7)) / 3, (322 + 13 * math.sqrt(70)) / 900), (math.sqrt(5 - 2 * math.sqrt(10 / 7)) / 3, (322 + 13 * math.sqrt(70)) / 900), (-math.sqrt(5 + 2 * math.sqrt(10 / 7)) / 3, (322 - 13 * math.sqrt(70)) / 900), (math.sqrt(5 + 2 * math.sqrt(10 / 7)) / 3, (322 - 13 * math.sqrt(70)) / 900))


def authalic(phi: Column, ecc: float = ECC) -> Column:
    """Area between the equator and a latitude (radians), per radian of longitude and squared equatorial radius."""
    s = F.sin(phi)
    if ecc == 0:
        return s
    return (s / (1 - ecc * ecc * s * s) + F.log((1 + ecc * s) / (1 - ecc * s)) / (2 * ecc)) * (1 - ecc * ecc) / 2


def side_area(lon: Column, lat: Column, lon2: Column, lat2: Column, radius: float = A, ecc: float = ECC) -> Column:
    """Signed area between the equator and a side that is straight in longitude and latitude (degrees); the sum over a ring's
    sides is its area.  A side goes the short way round."""
    step = F.radians(lon2 - lon)
    step = step - 2 * math.pi * F.round(step / (2 * math.pi))
    middle, half = F.radians((lat + lat2) / 2), F.radians((lat2 - lat) / 2)
    mean = sum((authalic(middle + half * t, ecc) * (w / 2) for t, w in GAUSS), F.lit(0.0))
    return -step * mean * radius * radius


def side_area_sql(lon: str, lat: str, lon2: str, lat2: str) -> str:
    """The same in SQL, for sides that do not cross the date line."""

    def q(phi: str) -> str:
        s = f"sin({phi})"
        return f"(({s} / (1 - {E2!r} * {s} * {s}) + ln((1 + {ECC!r} * {s}) / (1 - {ECC!r} * {s})) / (2 * {ECC!r})) * (1 - {E2!r}) / 2)"

    mean = " + ".join(f"{w / 2!r} * {q(f'radians(({lat} + {lat2}) / 2 + ({lat2} - {lat}) / 2 * {t!r})')}" for t, w in GAUSS)
    return f"(radians({lon} - {lon2}) * ({mean}) * {A!r} * {A!r})"
