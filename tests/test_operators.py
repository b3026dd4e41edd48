"""Hand-made grids with known answers, and properties that hold for any grid."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasol.functions import algebra as A
from terrasol.operators import focal as N
from terrasol.operators import forest as T
from terrasol.operators import grid as G
from terrasol.operators import landscape as L
from terrasol.operators import patches as P
from terrasol.operators import windows as V
from terrasol.operators import zonal as Z
from terrasol.operators import components as components_module
from terrasol.operators.blocks import by_block
from terrasol.operators.components import components
from terrasol.sources import cells as C


def raster(spark, rows, band="z", kind="double"):
    """A cell table of a list of rows; None is NoData."""
    return spark.createDataFrame([(r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)], f"row int, col int, {band} {kind}")


def values(df, band):
    return {(r.row, r.col): r[band] for r in df.collect()}


def test_inclined_plane(spark):
    plane = raster(spark, [[2.0 * c + 1.0 * r for c in range(9)] for r in range(9)])
    want = math.degrees(math.atan(math.sqrt(5)))
    slope = values(N.slope(plane, "z"), "slope")
    assert slope[0, 0] is None and slope[4, 4] == pytest.approx(want)
    edges = values(N.slope_with_edges(plane, "z"), "slope")
    assert all(v == pytest.approx(want) for v in edges.values())
    assert values(N.tpi(plane, "z"), "tpi")[4, 4] == pytest.approx(0)
    assert all(v == pytest.approx(0) for v in values(N.focal_sd(N.slope(plane, "z"), "slope", 2, size=4), "sd").values() if v is not None)


def test_cone_aspect_points_outwards(spark):
    cone = raster(spark, [[-math.hypot(r - 10, c - 10) for c in range(21)] for r in range(21)])
    a = values(N.aspect(cone, "z"), "aspect")
    assert a[2, 10] == pytest.approx(0, abs=1e-6) and a[10, 18] == pytest.approx(90) and a[18, 10] == pytest.approx(180) and a[10, 2] == pytest.approx(270)


def test_flat_and_hole(spark):
    rows = [[5.0] * 9 for _ in range(9)]
    rows[4][4] = None
    g = raster(spark, rows)
    assert values(N.aspect(g, "z"), "aspect")[1, 1] is None
    slope = values(N.slope(g, "z"), "slope")
    assert slope[4, 4] is None and slope[3, 3] is None and slope[1, 1] == 0
    lenient = values(N.focal_mean(g, "z", 1, strict=False), "mean")
    assert lenient[4, 4] == 5 and values(N.focal_mean(g, "z", 1), "mean")[4, 4] is None


def test_block_size_changes_nothing(spark):
    rng = random.Random(1)
    g = raster(spark, [[None if rng.random() < 0.1 else rng.random() * 9 for _ in range(23)] for _ in range(17)])
    one = values(N.focal_sd(g, "z", 3, size=64), "sd")
    for size in (5, 8):
        other = values(N.focal_sd(g, "z", 3, size=size), "sd")
        assert other.keys() == one.keys() and all((a is None and other[k] is None) or a == pytest.approx(other[k]) for k, a in one.items())


def test_missing_cells_are_nodata(spark):
    rng = random.Random(2)
    full = [[rng.random() if rng.random() < 0.7 else None for _ in range(12)] for _ in range(12)]
    g = raster(spark, full)
    holes = g.where("z is not null")
    a, b = values(N.slope(g, "z"), "slope"), values(N.slope(holes, "z"), "slope")
    assert all(a[k] == v for k, v in b.items())
    assert values(G.complete(holes, ["z"]), "z").keys() >= b.keys()


@pytest.mark.parametrize("neighbours,count", [(4, 18), (8, 1)])
def test_checkerboard(spark, neighbours, count):
    board = raster(spark, [[(r + c) % 2 for c in range(6)] for r in range(6)], kind="int")
    assert P.label_patches(board, "z", 6, neighbours).select("patch_id").distinct().count() == count


def test_labels_match_flood_fill(spark):
    rng = random.Random(3)
    rows = [[int(rng.random() < 0.55) for _ in range(80)] for _ in range(25)]
    for neighbours in (4, 8):
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (neighbours == 8 or not (a and b))]
        label = {}
        for r in range(25):
            for c in range(80):
                if rows[r][c] and (r, c) not in label:
                    todo, label[r, c] = [(r, c)], r * 80 + c
                    while todo:
                        y, x = todo.pop()
                        for a, b in steps:
                            k = (y + a, x + b)
                            if 0 <= k[0] < 25 and 0 <= k[1] < 80 and rows[k[0]][k[1]] and k not in label:
                                label[k] = r * 80 + c
                                todo.append(k)
        got = values(P.label_patches(raster(spark, rows, kind="int").repartition(5), "z", 80, neighbours), "patch_id")
        assert got == label


@pytest.mark.parametrize("local", [True, False])
def test_components_over_many_tasks(spark, monkeypatch, local):
    monkeypatch.setattr(components_module, "JOINED", 16)
    rounds = []
    monkeypatch.setattr(components_module, "_rounds", lambda edges, f=components_module._rounds: rounds.append(1) or f(edges))
    pairs = [(i, i + 1) for i in range(600) if i % 20] if local else [(i * 7919 % 601, (i + 1) * 7919 % 601) for i in range(600) if i % 50]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a int, b int").repartition(5)).collect()}
    want = {n: n for p in pairs for n in p}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
        if all(want[a] == want[b] for a, b in pairs):
            break
    assert got == want
    assert bool(rounds) != local  # numbers that are places need no rounds


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_square_and_ring(spark):
    square = P.label_runs(raster(spark, [[1] * 3] * 3, kind="int"), "z", 3)
    cells = P.run_cells(square)
    assert P.patch_area(square).first().area == 9 and P.patch_perimeter(cells).first().perimeter == 12
    assert P.patch_convexity(square).first().convexity == 1
    ring = raster(spark, [[1, 1, 1], [1, 0, 1], [1, 1, 1]], kind="int")
    cells = P.label_patches(ring, "z", 3)
    assert P.patch_perimeter(cells).first().perimeter == 16
    points = P.patch_outline(cells)
    assert points.count() == 8  # corners of the outline and of the hole
    m = P.ring_measures(points).first()
    assert (m.superficie, m.perimetre) == (8, 16)
    smooth = P.ring_measures(P.chaikin_rings(points)).first()
    assert smooth.superficie < 9 and smooth.perimetre < 16
    assert P.simplify_rings(points, 0.4).groupBy("ring").count().where("count < 3").count() == 0
    back = P.rasterize_patches(P.rings_of(points))
    assert values(back, "patch_id").keys() == {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}


def test_squares_at_exact_distance(spark):
    low = spark.createDataFrame([(1, 0, 0)], "patch_id long, row int, col int")
    steep = spark.createDataFrame([(4, 5)], "row int, col int")  # boxes 3 and 4 cells apart: distance 5
    assert P.near_patches(low, steep, 5.0).count() == 1 and P.near_patches(low, steep, 4.99).count() == 0


def test_distance_zone_matches_all_pairs(spark):
    rng = random.Random(5)
    rows = [[int(rng.random() < 0.03) for _ in range(30)] for _ in range(20)]
    sources = [(r, c) for r in range(20) for c in range(30) if rows[r][c]]
    got = values(N.distance_zone(raster(spark, rows, kind="int"), F.col("z") == 1, 6.0), "distance")
    for (r, c), d in got.items():
        want = min(math.hypot(r - y, c - x) for y, x in sources)
        assert (d is None) == (want >= 6) and (d is None or d == pytest.approx(want))


def test_constant_probability_through_windows(spark):
    g = raster(spark, [[0.25] * 12 for _ in range(12)], "p0").withColumn("p1", 1 - F.col("p0"))
    merged = V.hann_merge(V.overlap_windows(g, 8, 4), ["p0", "p1"], 8)
    inner = values(merged, "p0")
    assert inner[0, 0] is None and inner[5, 5] == pytest.approx(0.25) and values(merged, "p1")[5, 5] == pytest.approx(0.75)
    assert values(V.max_prob_mosaic(V.overlap_windows(g, 8, 4), ["p0", "p1"], 8), "p")[0, 0] == 0


def test_model_output_of_wrong_length_fails(spark):
    packed = spark.createDataFrame([(0, 0, [1.0] * 4)], "i int, j int, b array<double>")
    with pytest.raises(Exception, match="not 8"):
        V.score_windows(packed, ["b"], 2, lambda: lambda bands: [0.5], 2).collect()


def test_split_and_mosaic_give_the_whole(spark):
    g = raster(spark, [[float(r * 40 + c) for c in range(40)] for r in range(8)])
    strips = G.split_strips(g, 40, 8, 3, 4, 4)
    offsets = {s[0]: s[1] for s in G.strips(40, 8, 3, 4, 4)}
    back = [strips.where(F.col("strip") == s).select("row", (F.col("col") + o).cast("int").alias("col"), "z") for s, o in offsets.items()]
    got, whole = values(G.mosaic_mean(back, ["z"]), "z"), values(g, "z")
    assert got and all(whole[k] == v for k, v in got.items())


def test_resampling_an_aligned_grid_copies(spark):
    g = raster(spark, [[float(r * 5 + c) for c in range(5)] for r in range(5)])
    target = g.select(F.col("row").alias("trow"), F.col("col").alias("tcol"), (F.col("col") + 0.5).alias("x"), (-(F.col("row") + 0.5)).alias("y"))
    got = {(r.trow, r.tcol): r.z for r in G.resample_bilinear(g, "z", target).collect()}
    assert got == values(g, "z")


def test_lambert_round_trip(spark):
    d = spark.createDataFrame([(3.0, 46.5), (5.27, 44.17)], "lon double, lat double")
    x, y = A.to_lambert93(F.col("lon"), F.col("lat"))
    there = d.select("lon", "lat", x.alias("x"), y.alias("y"))
    first = there.first()
    assert first.x == pytest.approx(700000, abs=1e-6) and first.y == pytest.approx(6600000, abs=1e-3)
    lon, lat = A.to_wgs84(F.col("x"), F.col("y"))
    for r in there.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-10) and r.b == pytest.approx(r.lat, abs=1e-10)


def test_thresholds_and_flags(spark):
    assert A.thresholds()[3] == 0.35 and len(A.thresholds()) == 9
    row = spark.createDataFrame([(None, None, None)], "a double, b double, c double").select(*A.diagnostics(F.col("a"), F.col("b"), F.col("c"))).first()
    assert tuple(row) == (0, 1, 1)


def test_one_bad_tile_is_reported(spark):
    tiles = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "tile string, v int")

    def work(data):
        if data["tile"][0].as_py() == "a":
            raise ValueError("corrupt")
        return data.num_rows

    got = {r.tile: (r.status, r.n, r.message) for r in C.per_tile(tiles, "tile", work).collect()}
    assert got == {"a": ("ERREUR", None, "corrupt"), "b": ("OK", 2, None)}


def test_guards(spark):
    grid = spark.createDataFrame([("g", 0.0, 0.0, 0.5, 0.5, 1, 1, "x")], "grid_id string, x_min double, y_max double, res_x double, res_y double, nrows int, ncols int, crs string")
    with pytest.raises(ValueError):
        G.require_resolution(grid)
    with pytest.raises(ValueError, match="b"):
        T.align_features(spark.createDataFrame([(1,)], "a int"), ["a", "b"])
    assert T.align_features(spark.createDataFrame([(1, 2)], "b int, a int"), ["a", "b"]).columns == ["a", "b"]


def test_forest_prefers_the_signal(spark):
    rng = random.Random(6)
    rows = [(i, 0, s, rng.random(), int(s > 0.7)) for i in range(1500) for s in [rng.random()]]
    t = spark.createDataFrame(rows, "row int, col int, signal double, noise double, label int")
    model = T.train_forest(T.training_table(t), ["signal", "noise"], trees=8, depth=4)
    assert T.permutation_importance(model, t).first().feature == "signal"
    assert T.forest_error(model, t.select("signal", "noise", "label")).first().brier < 0.21
    some = T.predict_cells(model, t.select("row", "col", F.when(F.col("row") > 0, F.col("signal")).alias("signal"), "noise").limit(5))
    assert some.where("p0 is null").count() == 1 and some.where("abs(p0 + p1 - 1) < 1e-9").count() == 4


def test_filter_report_adds_up(spark):
    t = spark.createDataFrame([("a", 1, 5), ("a", 0, 5), ("a", None, 5), ("b", 1, 50)], "layer string, flag int, area int")
    for r in Z.filter_report(t, "layer", {"flag": F.col("flag") == 1, "area": F.col("area") <= 10}).collect():
        assert r.rows_in == r.removed_flag + r.removed_area + r.left_area


def test_scenario_pairs():
    s = L.sensitivity_grid()
    assert len(s) == 9 and len(L.pairs_of(s, True)) == 18 and len(L.pairs_of(s, False)) == 36
    assert len(L.sensitivity_grid((30,), (25, 35))) == 1


def test_jaccard_of_itself_is_one(spark):
    s = [("a", 1.0, 2.0, 1.0), ("b", 2.0, 2.0, 1.0)]
    cells = spark.createDataFrame([(n, 1, r, c) for n in "ab" for r in range(3) for c in range(3)], "scenario_id string, patch_id long, row int, col int")
    assert L.jaccard_pairs(cells, s).first().jaccard == 1
    assert L.jaccard_pairs(cells.limit(0), s).count() == 0


def test_empty_tables(spark):
    e = raster(spark, [[1.0]]).limit(0)
    for out in (N.slope(e, "z"), N.focal_mean(e, "z"), N.focal_sd(e, "z"), N.slope_with_edges(e, "z"), P.label_patches(e, "z", 10), G.mosaic_mean([e, e], ["z"]), V.overlap_windows(e, 4, 2), Z.zone_sizes(e, "z"), A.minmax_scale(e, ["z"])):
        assert out.count() == 0


def test_mode_of_any_values_against_loops(spark):
    draw = random.Random(4)
    rows = [(r, c, draw.choice([None, "b", "é", "a", "aa"])) for r in range(9) for c in range(7) if (r, c) != (4, 4)]
    known = {(r, c): v for r, c, v in rows}
    df = spark.createDataFrame(rows, "row int, col int, v string")
    got = {(r.row, r.col): r["mode"] for r in N.mode_filter(df, "v", 1, size=4).collect()}
    for (r, c), mode in got.items():
        near = [known.get((r + a, c + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        near = [v for v in near if v is not None]
        assert mode == (min(set(near), key=lambda v: (-near.count(v), v.encode())) if near else None)
    assert got.keys() == known.keys()
    # no cell is copied to each of its neighbours
    plan = N.mode_filter(df, "v", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_only_parts_that_may_be_names_are_shuffled(spark):
    tiles = spark.createDataFrame([("T01",), ("T02",), ("",), ("none",)], "name string")
    images = spark.createDataFrame([(f"/data/T{i % 3:02d}/image_{i:05d}.tif",) for i in range(300)], "path string")
    found = G.match_tile_image(tiles, images)
    assert {r.name: r.path for r in found.collect()} == {"T01": "/data/T01/image_00001.tif", "T02": "/data/T02/image_00002.tif", "": "/data/T00/image_00000.tif", "none": None}
    assert "_bits" in found._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_hold_no_more_than_their_cells(spark):
    narrow = spark.createDataFrame([(r, c, 1.0) for r in range(30) for c in range(3)], "row int, col int, v double")
    got = by_block(narrow, ["v"], 2, {"area": lambda g: np.full(g["v"].shape, float(g["v"].size))}, size=512)
    assert {r.area for r in got.collect()} == {90.0}
