"""Quantiles of huge groups, areas on the ellipsoid, tile files that cannot be read, names in paths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasol.functions.geodesy import side_area
from terrasol.operators import grid as G
from terrasol.operators import patches as P
from terrasol.operators.focal import envelope
from terrasol.operators.selection import group_quantile
from terrasol.sources import cells as C


@pytest.mark.parametrize("p", [0.1, 0.5, 1.0])
def test_quantiles_equal_numpy(spark, p):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.uniform(-5, 5, 3000),
        "skewed": np.concatenate([rng.lognormal(0, 12, 2000), [1e300, -1e300, 1.7e308, -1.7e308]]),
        "equal": np.full(2500, 7.0),
        "ties": rng.integers(0, 3, 2500).astype(float),
        None: rng.normal(0, 1, 1500),
        "few": rng.normal(0, 1, 9),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("few", None), ("even", None)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r["quantile"] for r in group_quantile(df, "k", "v", p, few=50, bins=8 if p == 0.5 else 64).collect()}
    want = {k: float(np.quantile(v, p)) for k, v in groups.items()} | {"none": None}
    assert got.keys() == want.keys() and got["none"] is None
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-15) for k in groups)


def test_quantile_of_nothing(spark):
    assert group_quantile(spark.createDataFrame([], "k string, v double"), "k", "v", 0.1).count() == 0


def test_ellipsoid_areas(spark):
    """A quarter of a hemisphere, a cap of a sphere, known squares of one degree, and a hole."""
    half = 510065621724.0 / 2  # square kilometres times 1e3: half of the surface of the ellipsoid, in square metres / 1e3
    ring = lambda k, r, ps: [(k, r, i, float(x), float(y)) for i, (x, y) in enumerate(ps)]
    rows = ring(1, 0, [(0, 0), (90, 0), (90, 90), (0, 90)]) + ring(2, 0, [(3, 46), (4, 46), (4, 47), (3, 47)]) + ring(3, 0, [(3, 46), (5, 46), (5, 47), (3, 47)]) + ring(3, 1, [(3.5, 46.25), (3.5, 46.75), (4.5, 46.75), (4.5, 46.25)]) + ring(4, 0, [(179.5, 0), (-179.5, 0), (-179.5, 1), (179.5, 1)])
    got = {r.patch_id: r.area for r in P.ellipsoid_area(spark.createDataFrame(rows, "patch_id long, ring int, idx int, x double, y double")).collect()}
    assert math.isclose(got[1], half * 1e3 / 4, rel_tol=1e-3)  # one side spans 90 degrees
    m, n = 6378137.0 * (1 - 0.00669438) / (1 - 0.00669438 * math.sin(math.radians(46.5)) ** 2) ** 1.5, 6378137.0 / math.sqrt(1 - 0.00669438 * math.sin(math.radians(46.5)) ** 2)
    assert math.isclose(got[2], m * n * math.cos(math.radians(46.5)) * math.radians(1) ** 2, rel_tol=1e-4)
    assert math.isclose(got[3], 1.5 * got[2], rel_tol=1e-4)
    assert math.isclose(got[4], 111319.49 * 110574.3, rel_tol=1e-4)
    sphere = spark.range(1).select(sum((side_area(F.lit(float(x)), F.lit(60.0), F.lit(float(x + 10)), F.lit(60.0), 1.0, 0.0) for x in range(0, 360, 10)), F.lit(0.0)).alias("a")).first().a
    assert math.isclose(2 * math.pi + sphere, 2 * math.pi * (1 - math.sin(math.radians(60))), rel_tol=1e-9)


def test_files_that_cannot_be_read(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(k, i) for i in range(10 + k)], "k int, i int").coalesce(1).write.parquet(str(tmp_path / f"tile{k}"))
    broken = next((tmp_path / "tile1").glob("part-*.parquet"))
    broken.write_bytes(broken.read_bytes()[:60])
    damaged = next((tmp_path / "tile2").glob("part-*.parquet"))  # its length is right, its bytes are not Parquet, and no checksum tells
    damaged.write_bytes(b"x" * 100)
    next((tmp_path / "tile2").glob(".part-*.crc")).unlink()
    (tmp_path / "tile9").mkdir()
    (tmp_path / "tile9" / "notes.md").write_text("no tile")

    def work(table):
        if table.num_rows == 13:
            raise ValueError("x" * 500)
        return table.num_rows

    got = {r.tile: r for r in C.file_outcomes(spark, str(tmp_path), r"^part-.*parquet$", work).collect()}
    assert {k: (r.status, r.n) for k, r in got.items()} == {"tile0": ("OK", 10), "tile1": ("ERREUR", None), "tile2": ("ERREUR", None), "tile3": ("ERREUR", None), "tile9": ("MANQUANT", None)}
    assert got["tile3"].message == "ValueError: " + "x" * 500 and got["tile1"].message
    report = {r.status: (r.tiles, r["items"]) for r in C.tile_report(C.file_outcomes(spark, str(tmp_path), r"^part-.*parquet$", work)).collect()}
    assert report == {"OK": (1, 10), "ERREUR": (3, 0), "MANQUANT": (1, 0)}


def test_names_in_paths(spark):
    tiles = spark.createDataFrame([("T1",), ("T12",), ("a_b",), ("é%",), ("",), (None,), ("absent",), ("T1",)], "name string")
    images = spark.createDataFrame([("/z/T12.tif",), ("/y/T1",), ("/a_b/é%x",), (None,), ("",)], "path string")
    got = sorted(((r.name, r.path) for r in G.match_tile_image(tiles, images).collect()), key=repr)
    assert got == sorted([("T1", "/y/T1"), ("T12", "/z/T12.tif"), ("a_b", "/a_b/é%x"), ("é%", "/a_b/é%x"), ("", ""), (None, None), ("absent", None), ("T1", "/y/T1")], key=repr)
    plan = G.match_tile_image(tiles, images)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") <= 1  # only the one-row table beside


def test_distances_equal_all_pairs():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.001, 0.02, 0.5, 1.0):
        has = rng.random((37, 53)) < share
        got = envelope(has)
        r, c = np.nonzero(has)
        y, x = np.mgrid[:37, :53]
        want = ((y[..., None] - r) ** 2 + (x[..., None] - c) ** 2).min(-1) if len(r) else np.full(has.shape, np.inf)
        assert np.array_equal(got, want)
