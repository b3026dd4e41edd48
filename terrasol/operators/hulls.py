"""Convex hulls of point sets of any size: partial hulls of bands, merged up a tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasol.sources.store import cut

#: distinct heights of a band, and bands merged at a time
BAND = 1024
FAN = 16
#: points that go to one task, about
TOGETHER = 1 << 17


def _chain(points: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for p in points:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
            out.pop()
        out.append(p)
    return out[:-1]


def hull(x: list, y: list) -> list[tuple]:
    """Corners of the convex hull, anticlockwise, by monotone chains."""
    points = sorted(set(zip(x, y)))
    return points if len(points) < 3 else _chain(points) + _chain(points[::-1])


def hull_points(points: DataFrame, key: str, height: float, least: float, most: float, band: int = BAND, fan: int = FAN) -> DataFrame:
    """(key, x, y) of each key's hull corners, of points (key, x, y) with y from `least` to `most`.

    Points go to bands of `band` heights; tasks make the hulls of each band of each key, then of `fan` neighbouring bands' hulls, until one band spans
    all.  A hull of whole-numbered corners in a band has few corners, so tasks stay small whatever the key holds."""
    kind = points.schema[key].dataType.simpleString()

    def run(width: int):
        def merged(data: pa.Table) -> pa.Table:
            data = data.combine_chunks()
            code = data[key].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            old = data["band"].to_numpy()
            band = old // width
            order = np.lexsort([old, band, code])
            code, old, band = code[order], old[order], band[order]
            x, y = data["x"].to_numpy()[order].tolist(), data["y"].to_numpy()[order].tolist()
            new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (band[1:] != band[:-1])]))
            at, corners = [], []
            for i, j in zip(new.tolist(), [*new[1:].tolist(), len(x)]):
                # the hull of one band is one already
                some = list(zip(x[i:j], y[i:j])) if width > 1 and old[i] == old[j - 1] else hull(x[i:j], y[i:j])
                corners += some
                at += [i] * len(some)
            at = np.array(at, np.int64)
            return pa.table({key: data[key].combine_chunks().take(pa.array(order[at])), "band": pa.array(band[at], pa.int64()), "x": pa.array([c[0] for c in corners], pa.float64()), "y": pa.array([c[1] for c in corners], pa.float64())})

        return merged

    def dealt(df: DataFrame, width: int) -> DataFrame:
        """Bands are small and many: a task merges all of a bunch."""
        bunches = max(1, -(-df.count() // TOGETHER))
        bunch = F.pmod(F.xxhash64(key, F.floor(F.col("band") / width)), F.lit(bunches)).alias("_bunch")
        return df.groupBy(bunch).applyInArrow(run(width), f"{key} {kind}, band bigint, x double, y double")

    now = points.select(key, F.floor((F.col("y") - least) / (height * band)).cast("bigint").alias("band"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    now = dealt(now, 1)
    bands = int((most - least) / (height * band)) + 1
    while bands > 1:
        bands = -(-bands // fan)
        now = dealt(cut(now), fan)
    return now.select(key, "x", "y")


def hull_area(points: DataFrame, key: str, height: float = 1.0, band: int = BAND, fan: int = FAN) -> DataFrame:
    """(key, hull): area of each key's convex hull, 0 if its points lie on a line."""
    ends = points.agg(F.min("y"), F.max("y")).first()
    if ends[0] is None:
        return points.select(key, F.lit(0.0).alias("hull"))
    corners = hull_points(points, key, height, float(ends[0]), float(ends[1]), band, fan)
    # corners in the order of their angle around the middle, which a hull's own order is
    ordered = corners.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.collect_list(F.struct("x", "y")).alias("p"))
    turned = ordered.select(key, F.array_sort(F.transform("p", lambda q: F.struct(F.atan2(q["y"] - F.col("my"), q["x"] - F.col("mx")).alias("a"), q["x"].alias("x"), q["y"].alias("y")))).alias("p"))
    after = F.concat(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, 1))
    cross = F.zip_with("p", after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return turned.select(key, F.when(F.size("p") > 2, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(0.0).alias("hull"))
