"""Outlines, hulls and simplified borders of patches, against walks and hulls in plain Python."""

import random

import numpy as np
import pytest

from terrasol.operators import hulls as H
from terrasol.operators import outlines as O
from terrasol.operators import patches as P
from terrasol.operators import ranks as R
from terrasol.operators import topology as T
from terrasol.plans import patch_queries
from tests.conftest import DATA

TURN = {(1, 0): 0, (0, 1): 1, (-1, 0): 2, (0, -1): 3}


def walk(cells):
    """Rings of a set of cells (row, col), each from its first corner in reading order: follow sides, right turns first."""
    sides = set()
    for r, c in cells:
        for dr, dc, x, y, d in ((-1, 0, c, r, 0), (0, 1, c + 1, r, 1), (1, 0, c + 1, r + 1, 2), (0, -1, c, r + 1, 3)):
            if (r + dr, c + dc) not in cells:
                sides.add((x, y, d))
    rings = []
    while sides:
        y, x, d = min((y, x, d) for x, y, d in sides)
        ring = []
        while (x, y, d) in sides:
            sides.remove((x, y, d))
            ring.append((x, y, d))
            x, y = x + (1, 0, -1, 0)[d], y + (0, 1, 0, -1)[d]
            d = next((e % 4 for e in (d + 1, d, d + 3) if (x, y, e % 4) in sides), d)
        rings.append(ring)
    return sorted(rings, key=lambda r: (r[0][1], r[0][0]))


def corners(ring):
    return [(x, y) for i, (x, y, d) in enumerate(ring) if d != ring[i - 1][2]]


def cells_of(spark, patches):
    return spark.createDataFrame([(k, r, c) for k, cells in patches.items() for r, c in cells], "patch_id long, row int, col int")


def outline(spark, patches, size, every=False):
    got = {}
    for r in P.patch_outline(cells_of(spark, patches), size=size, every=every).collect():
        got.setdefault((r.patch_id, r.ring), {})[r.idx] = (r.x, -r.y)
    return {k: [v[i] for i in range(len(v))] for k, v in got.items()}


def blob(rng, n, side):
    return {(rng.randrange(side), rng.randrange(side)) for _ in range(n)}


RNG = random.Random(3)
SHAPES = {
    1: {(2, 3)},
    2: {(10, c) for c in range(10, 30)} | {(r, 10) for r in range(10, 25)},
    3: {(r, c) for r in range(40, 60) for c in range(40, 60)} - {(r, c) for r in range(45, 50) for c in range(44, 57)} - {(52, 52), (53, 53)},
    4: {(70, 70), (71, 71), (72, 70), (71, 69)},
    5: {(r + 100, c + 100) for r, c in blob(RNG, 500, 30)},
}


@pytest.mark.parametrize("size", [3, 7, 512])
def test_outlines_equal_walks(spark, size, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 50)
    got = outline(spark, SHAPES, size)
    for k, cells in SHAPES.items():
        rings = [corners(r) for r in walk(set(cells))]
        assert [got[k, i] for i in range(len(rings))] == rings and (k, len(rings)) not in got
    if size == 7:
        every = outline(spark, SHAPES, size, True)
        assert all(every[k, i] == [(x, y) for x, y, _ in r] for k, cells in SHAPES.items() for i, r in enumerate(walk(set(cells))))


def test_one_patch_over_many_blocks_and_pieces(spark, monkeypatch):
    """Half of a grid as one patch with combs and holes: tasks hold a block's sides, chains are cut to pieces."""
    monkeypatch.setattr(O, "PIECE", 40)
    cells = {(r, c) for r in range(120) for c in range(60) if r % 4 != 3 or c == 0 or c == 30}
    cells -= {(r, 20) for r in range(1, 100, 4)}
    got = outline(spark, {9: cells}, 16)
    rings = [corners(r) for r in walk(set(cells))]
    assert len(rings) > 20 and [got[9, i] for i in range(len(rings))] == rings
    empty = P.patch_outline(spark.createDataFrame([], "patch_id long, row int, col int"))
    assert empty.count() == 0


def test_list_ranking(spark):
    nodes = list(range(100, 160))
    RNG.shuffle(nodes)
    links = [(a, b, a % 5 + 1) for a, b in zip(nodes, nodes[1:] + nodes[:1])] + [(7, 7, 4)]
    got = {r.chain: (r.ring, r["at"], r.total) for r in O.rank_lists(spark.createDataFrame(links, "chain long, next long, steps long")).collect()}
    begin, total = nodes.index(100), sum(a % 5 + 1 for a in nodes)
    at = 0
    for n in nodes[begin:] + nodes[:begin]:
        assert got[n] == (100, at, total)
        at += n % 5 + 1
    assert got[7] == (7, 0, 4)


def area(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


@pytest.mark.parametrize("band,fan", [(1, 2), (5, 3), (1024, 16)])
def test_merged_hulls(spark, band, fan):
    rng = np.random.default_rng(2)
    sets = {1: rng.integers(0, 90, (400, 2)).tolist(), 2: [[i, i] for i in range(40)], 3: [[4, 80]], 4: [[x, y] for x in range(12) for y in range(50, 62)]}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, ps in sets.items() for x, y in ps], "patch_id long, x double, y double")
    got = {r.patch_id: r.hull for r in H.hull_area(df, "patch_id", 1.0, band, fan).collect()}
    assert got == {1: area(H.hull(*zip(*sets[1]))), 2: 0.0, 3: 0.0, 4: 121.0}


def patches_of(points):
    rings = {}
    for r in points.collect():
        rings.setdefault((r.patch_id, r.ring), {})[r.idx] = (r.x, r.y)
    return {k: [v[i] for i in range(len(v))] for k, v in rings.items()}


def sides(rings):
    out = {}
    for ring in rings.values():
        for a, b in zip(ring, ring[1:] + ring[:1]):
            out.setdefault((min(a, b), max(a, b)), []).append(a < b)
    return out


@pytest.mark.parametrize("keep,piece", [(0.4, 1 << 16), (1.0, 1 << 16), (0.0, 5)])
def test_shared_borders_stay_shared(spark, keep, piece, monkeypatch):
    """Zones that tile a square, with an island and a ring-shaped zone: afterwards every side inside has a zone on both hands."""
    monkeypatch.setattr(T, "PIECE", piece)
    monkeypatch.setattr(R, "RANGE_ROWS", 64)
    rng, side = random.Random(8), 24
    seeds = [(rng.randrange(side), rng.randrange(side)) for _ in range(9)]
    zone = {(r, c): min(range(9), key=lambda k: (abs(r - seeds[k][0]) + abs(c - seeds[k][1]), k)) for r in range(side) for c in range(side)}
    zone |= {(r, c): 20 for r in range(8, 16) for c in range(8, 16)} | {(r, c): 21 for r in range(10, 14) for c in range(10, 14)}
    cells = spark.createDataFrame([(z, r, c) for (r, c), z in zone.items()], "patch_id long, row int, col int")
    points = P.patch_outline(cells, every=True)
    rows = points.collect()
    points = spark.createDataFrame(rows, points.schema)
    before, after = patches_of(points), patches_of(P.simplify_rings(points, keep))
    assert before.keys() == after.keys() and all(len(r) >= 3 for r in after.values())
    degree = {}
    for a, b in sides(before):
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    junctions = {p for p, d in degree.items() if d != 2}
    left = {p for r in after.values() for p in r}
    assert junctions <= left <= set(degree)
    for hands in sides(after).values():
        assert hands in ([True], [False], [True, False], [False, True])
    # the zones' signed areas add up to that of the outer ring, so there is neither gap nor overlap
    once = {}
    for (a, b), hands in sides(after).items():
        if len(hands) == 1:
            once[a if hands[0] else b] = b if hands[0] else a
    start = min(once)
    outer, p = [start], once[start]
    while p != start:
        outer.append(p)
        p = once[p]
    signed = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
    assert len(outer) == len(once) and abs(sum(map(signed, after.values())) - signed(outer)) < 1e-9
    if keep == 1.0:
        assert {k: set(v) for k, v in after.items()} == {k: set(v) for k, v in before.items()}
    if keep == 0.4 and piece > 5:
        assert len(left) == len(degree) - int((len(degree) - len(junctions) - 3) * 0.6)  # the one closed arc keeps three corners


def test_simplified_rings_alone_and_by_tile(spark):
    """Rings without neighbours: the corners that stay are those of the heaviest triangles, over the layer or each tile."""
    rng = np.random.default_rng(4)
    rings = []
    for k in range(6):
        angle = np.sort(rng.uniform(0, 6.28, 30))
        rings += [(k, "ab"[k % 2], 0, i, float(100 * k + 20 * np.cos(a) * rng.uniform(0.7, 1)), float(20 * np.sin(a) * rng.uniform(0.7, 1))) for i, a in enumerate(angle)]
    df = spark.createDataFrame(rings, "patch_id long, tile string, ring int, idx int, x double, y double")
    weights = []
    for k in range(6):
        ps = [(r[4], r[5]) for r in rings if r[0] == k]
        w = T.effective_areas(np.array([p[0] for p in ps + ps[:1]]), np.array([p[1] for p in ps + ps[:1]]), 2)
        weights += [(float(v), k, p) for v, p in zip(w, ps)]
    for tile, mine in ((None, range(6)), ("a", (0, 2, 4)), ("b", (1, 3, 5))):
        some = sorted(w for w in weights if w[1] in mine and w[0] < float("inf"))
        want = {(k, p) for _, k, p in some[int(len(some) * 0.6) :]} | {(k, p) for v, k, p in weights if k in mine and v == float("inf")}
        got = P.simplify_rings(df, 0.4, "tile" if tile else None).where(f"tile = '{tile}'" if tile else "true").collect()
        assert {(r.patch_id, (r.x, r.y)) for r in got} == want
    assert P.simplify_rings(df.limit(0)).count() == 0


def test_burnt_polygons(spark):
    """Slanted, non-convex polygons with holes against a crossing count for every cell."""
    rng = random.Random(11)
    shapes = {
        1: [[(2.3, -1.2), (17.8, -4.4), (11.1, -9.7), (19.6, -18.3), (4.2, -15.1), (8.8, -8.9)], [(9.1, -5.2), (11.9, -5.9), (10.2, -7.7)]],
        2: [[(rng.uniform(0, 40), -rng.uniform(0, 40)) for _ in range(25)]],
        3: [[(30.0, -30.0), (34.0, -30.0), (34.0, -33.0), (30.0, -33.0)]],
        4: [[(1.2, -1.2), (1.3, -1.3), (1.2, -1.3)]],
    }
    polygons = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in shapes.items()], "patch_id long, rings array<array<struct<x:double,y:double>>>")
    want = set()
    for k, rings in shapes.items():
        edges = [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1])]
        for row in range(42):
            for col in range(42):
                x, y = col + 0.5, -(row + 0.5)
                hits = sum((a[1] > y) != (b[1] > y) and x >= (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges)
                if hits % 2:
                    want.add((k, row, col))
    from terrasol.operators.grid import burn

    assert {tuple(r) for r in burn(polygons, "patch_id").collect()} == want
    points = spark.createDataFrame([(k, i, j, x, y) for k, rings in shapes.items() for i, r in enumerate(rings) for j, (x, y) in enumerate(r)], "patch_id long, ring int, idx int, x double, y double")
    best = {}
    for k, r, c in want:
        best[r, c] = max(k, best.get((r, c), 0))
    assert {(r.row, r.col): r.patch_id for r in P.rasterize_rings(points).collect()} == best


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_exposed_sides_without_a_join(spark):
    """One shuffle of the cells to blocks, no four rows a cell; patches may share cells, repeated cells repeat their sides."""
    rng = random.Random(5)
    cells = [(k, rng.randrange(-6, 12), rng.randrange(-6, 12)) for k in (3, 8, None) for _ in range(120)]
    df = spark.createDataFrame(cells, "patch_id long, row int, col int")
    have = {c for c in cells if c[0] is not None}
    want = sorted(((k, r, c, s) for k, r, c in cells for s, dr, dc in (("n", -1, 0), ("e", 0, 1), ("s", 1, 0), ("w", 0, -1)) if (k, r + dr, c + dc) not in have), key=repr)
    for size in (4, 512):
        assert sorted(map(tuple, P.exposed_edges(df, size).collect()), key=repr) == want
    assert "Join" not in plan_of(P.exposed_edges(df))
    assert P.exposed_edges(df.limit(0)).count() == 0


def test_outlines_send_no_table_to_all_tasks(spark):
    """Corners take their places from their chain's, not from a ranking of all corners."""
    assert "Broadcast" not in plan_of(P.patch_outline(cells_of(spark, SHAPES), size=7))


def test_small_groups_are_ranked_in_one_shuffle(spark, monkeypatch):
    """Large groups go through ranges, the rest of the table does not; both give the same places."""
    monkeypatch.setattr(R, "RANGE_ROWS", 20)
    rows = [(g, i * 7 % 50, i % 3) for g, n in ((None, 5), (1, 50), (2, 20), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, v long, w long")
    got = {(r.g, r.v): (r["rank"], r.n) for r in R.ranked(df, ["v"], by=("g",)).collect()}
    weighed = {(r.g, r.v): (r["rank"], r.n) for r in R.ranked(df, ["v"], by=("g",), weight="w").collect()}
    for g in (None, 1, 2, 3):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for i, r in enumerate(mine):
            assert got[g, r[1]] == (i, len(mine))
            assert weighed[g, r[1]] == (sum(x[2] for x in mine[:i]), sum(x[2] for x in mine))
    ranges = []
    before = R._in_ranges
    monkeypatch.setattr(R, "_in_ranges", lambda whole, *a: (ranges.append(whole.count()), before(whole, *a))[1])
    R.ranked(df, ["v"], by=("g",)).count()
    assert ranges == [50]


def test_many_lines_are_weighed_together():
    """Short and long lines, equal weights and closed ones among them: as one by one."""
    rng = np.random.default_rng(6)
    lines = [rng.integers(0, 9, (n, 2)).astype(float) for n in [*rng.integers(1, 12, 300), 64, 65, 200, 64, 0 + 2]]
    first = np.cumsum([0, *map(len, lines)])[:-1]
    floor = rng.integers(0, 3, len(lines))
    whole = np.concatenate(lines)
    got = T.many_areas(whole[:, 0], whole[:, 1], first, floor)
    assert np.array_equal(got, np.concatenate([T.effective_areas(p[:, 0], p[:, 1], f) for p, f in zip(lines, floor)]))


def test_hulls_of_many_patches_share_tasks(spark, monkeypatch):
    """Bands of all patches go to bunches, not to a group each; null is a key like any other."""
    monkeypatch.setattr(H, "TOGETHER", 300)
    rng = np.random.default_rng(7)
    sets = {k: rng.integers(0, 40, (25, 2)).tolist() for k in [None, *range(40)]}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, ps in sets.items() for x, y in ps], "patch_id long, x double, y double")
    corners = H.hull_points(df, "patch_id", 1.0, 0.0, 40.0, 4, 3)
    assert "_bunch" in plan_of(corners)
    got = {}
    for r in corners.collect():
        got.setdefault(r.patch_id, set()).add((r.x, r.y))
    assert got == {k: set(H.hull(*zip(*ps))) for k, ps in sets.items()}


def test_patches_of_every_bound_meet_cells_of_every_bound(spark):
    """Proximity for several bounds of either side in one go, as one by one; no row is repeated for a scenario."""
    rng = random.Random(9)
    low = [(a, p, rng.randrange(40), rng.randrange(40)) for a in (10.0, 15.0) for p in range(12) for _ in range(4)]
    steep = [(b, rng.randrange(40), rng.randrange(40)) for b in (25.0, 30.0) for _ in range(40)]
    lows = spark.createDataFrame(low, "low_max double, patch_id long, row int, col int")
    steeps = spark.createDataFrame(steep, "steep_min double, row int, col int")
    got = {tuple(r) for r in P.near_patches(lows, steeps, 1.0, low_by=("low_max",), steep_by=("steep_min",)).select("low_max", "steep_min", "patch_id").collect()}
    gap = lambda a, b: max(abs(a - b) - 1, 0)
    assert got == {(a, b, p) for a, p, r, c in low for b, y, x in steep if gap(r, y) ** 2 + gap(c, x) ** 2 <= 1}


def test_terrace_map_sends_no_table_to_all_tasks(spark):
    assert "Broadcast" not in plan_of(patch_queries.terrace_cells(spark, f"{DATA}/sf0.001"))
    points = spark.createDataFrame([(0, 0, 0.0, 0.0)], "patch_id long, idx int, x double, y double")
    assert "BroadcastHashJoin" not in plan_of(T.following(points, ["patch_id"])).split("HashAggregate")[0]
