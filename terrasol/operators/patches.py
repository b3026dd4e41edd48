"""Connected patches: labels, areas, outlines, shapes, proximity.

Patches are labelled on runs of cells along rows, not on cells: gaps and islands give the
runs, adjacent rows give the edges, and the graph's components give the labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasol.functions.geodesy import side_area
from terrasol.operators.blocks import grids, to_blocks
from terrasol.operators.components import components
from terrasol.operators.grid import burn, burn_sides, small
from terrasol.operators.hulls import hull_area
from terrasol.operators.outlines import outline
from terrasol.operators.topology import following, simplify
from terrasol.sources.store import cut

#: columns of a bucket in which runs of adjacent rows meet
BUCKET = 64


def runs(cells: DataFrame, band: str, ncols: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., row, c0, c1, run_id) of the stretches of cells with value 1; run_id is the first cell's linear number."""
    ones = cells.where(F.col(band) == 1)
    order = Window.partitionBy(*by, "row").orderBy("col")
    islands = ones.select(*by, "row", "col", (F.col("col") - F.row_number().over(order)).alias("_k"))
    return islands.groupBy(*by, "row", "_k").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).select(*by, "row", "c0", "c1", (F.col("row").cast("bigint") * ncols + F.col("c0")).alias("run_id"))


def run_edges(runs_: DataFrame, reach: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of runs of adjacent rows that touch: reach 0 for four neighbours, 1 for eight.  Runs meet
    under the column buckets they cover, so long rows do not pair all with all."""
    bucket = lambda hi: F.explode(F.sequence(F.floor(F.col("c0") / BUCKET), F.floor((F.col("c1") + hi) / BUCKET))).alias("_b")
    above = runs_.select(*by, (F.col("row") + 1).alias("row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("run_id").alias("a"), bucket(reach))
    here = runs_.select(*by, "row", "c0", "c1", F.col("run_id").alias("b"), bucket(reach))
    return above.join(here, [*by, "row", "_b"]).where((F.col("a0") <= F.col("c1") + reach) & (F.col("c0") <= F.col("a1") + reach)).select(*by, "a", "b").distinct()


def label_runs(cells: DataFrame, band: str, ncols: int, neighbours: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs with patch_id: the least linear cell number of the patch (within `by`, patches stay apart; several rasters
    in one table, told by grid_id, always do).

    With `by`, node numbers carry the group's number in their high digits, so all groups go through
    one labelling."""
    by = tuple(dict.fromkeys((*grids(cells), *by)))
    r = cut(runs(cells, band, ncols, by))
    edges = run_edges(r, 1 if neighbours == 8 else 0, by)
    if not by:
        found = components(edges)
        return r.join(found, r["run_id"] == found["node"], "left").select("row", "c0", "c1", F.coalesce("label", "run_id").alias("patch_id"))
    # groups are few (scenarios, tiles): their dense numbers come from a small sorted table
    names = r.select(*by).distinct()
    number = names.withColumn("_g", F.dense_rank().over(Window.orderBy(*by)).cast("bigint"))
    shift = F.lit(int(r.agg(F.max("run_id")).first()[0] or 0) + 1)
    tag = lambda c: F.col("_g") * shift + F.col(c)
    found = components(edges.join(small(number), list(by)).select(tag("a").alias("a"), tag("b").alias("b")))
    tagged = r.join(small(number), list(by)).withColumn("_n", tag("run_id"))
    out = tagged.join(found, tagged["_n"] == found["node"], "left")
    return out.select(*by, "row", "c0", "c1", F.coalesce(F.col("label") - F.col("_g") * shift, F.col("run_id")).alias("patch_id"))


def run_cells(labelled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., patch_id, row, col) of labelled runs."""
    return labelled.select(*by, "patch_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def label_patches(cells: DataFrame, band: str, ncols: int, neighbours: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells of value 1 with their patch: (by..., patch_id, row, col)."""
    return run_cells(label_runs(cells, band, ncols, neighbours, by), tuple(dict.fromkeys((*grids(cells), *by))))


def patch_area(labelled: DataFrame, res: float = 1.0, by: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """Area of each patch from its runs."""
    area = F.sum(F.col("c1") - F.col("c0") + 1) * res * res
    return labelled.groupBy(*by, "patch_id").agg((F.round(area, digits) if digits is not None else area).alias("area"))


def min_area_filter(patches: DataFrame, least: float = 10.0, area: str = "area") -> DataFrame:
    return patches.where(F.col(area) >= least)


def exposed_edges(patch_cells: DataFrame, size: int = 512) -> DataFrame:
    """(patch_id, row, col, side) of the cell sides without a cell of the same patch beyond; sides n e s w.

    One shuffle to blocks with a halo of one cell; a task holds one block and looks its cells up by number."""
    kind = patch_cells.schema["patch_id"].dataType.simpleString()

    def run(data: pa.Table) -> pa.Table:
        row, col = data["row"].to_numpy().astype(np.int64), data["col"].to_numpy().astype(np.int64)
        named = data["patch_id"].combine_chunks()
        code = named.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        nothing = np.isnan(code) if code.dtype.kind == "f" else np.zeros(len(code), bool)
        # a cell without a patch is alone
        code = np.where(nothing, len(code) + np.arange(len(code)), code).astype(np.int64)
        up, left = row.min() - 1, col.min() - 1
        width = col.max() - left + 2
        key = (code * (row.max() - up + 2) + row - up) * width + col - left
        have = np.unique(key)
        core = (row // size == data["block_row"][0].as_py()) & (col // size == data["block_col"][0].as_py())
        at, side = [], []
        for i, step in enumerate((-width, 1, width, -1)):
            want = key[core] + step
            alone = np.flatnonzero(core)[have[np.minimum(np.searchsorted(have, want), len(have) - 1)] != want]
            at.append(alone)
            side.append(np.full(len(alone), i))
        at = pa.array(np.concatenate(at))
        sides = pa.array(["n", "e", "s", "w"]).take(pa.array(np.concatenate(side)))
        return pa.table({"patch_id": named.take(at), "row": data["row"].combine_chunks().take(at), "col": data["col"].combine_chunks().take(at), "side": sides})

    kinds = ", ".join(f"{c} {patch_cells.schema[c].dataType.simpleString()}" for c in ("row", "col"))
    return to_blocks(patch_cells.select("patch_id", "row", "col"), size, 1).groupBy("block_row", "block_col").applyInArrow(run, f"patch_id {kind}, {kinds}, side string")


def patch_perimeter(patch_cells: DataFrame, res: float = 1.0) -> DataFrame:
    """Outline length, holes included."""
    return exposed_edges(patch_cells).groupBy("patch_id").agg((F.count("*") * res).alias("perimeter"))


def patch_outline(patch_cells: DataFrame, res: float = 1.0, x_min: float = 0.0, y_max: float = 0.0, size: int = 512, every: bool = False) -> DataFrame:
    """(patch_id, ring, idx, x, y): corner points of each patch's rings in walking order (all cell corners on them with
    `every`); patches may be of any size."""
    return outline(exposed_edges(patch_cells), res, x_min, y_max, size, every)


def _next(column: str) -> Column:
    """The following point's coordinate, around the ring."""
    w = Window.partitionBy("patch_id", "ring").orderBy("idx")
    return F.coalesce(F.lead(column).over(w), F.first(column).over(w))


def ring_measures(points: DataFrame) -> DataFrame:
    """Area (shoelace, holes subtract) and outline length of each patch's rings."""
    p = points.select("patch_id", "ring", "x", "y", _next("x").alias("x2"), _next("y").alias("y2"))
    each = p.groupBy("patch_id").agg(F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2).alias("superficie"), F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("perimetre"))
    return each


def ellipsoid_area(points: DataFrame, by: tuple[str, ...] = ("patch_id",)) -> DataFrame:
    """(by..., area): square metres on the ellipsoid of rings in degrees (x longitude, y latitude); holes subtract."""
    sides = following(points.select(*by, "ring", "idx", "x", "y"), [*by, "ring"])
    return sides.groupBy(*by).agg(F.abs(F.sum(side_area(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")))).alias("area"))


def chaikin_rings(points: DataFrame) -> DataFrame:
    """One corner-cutting refinement: each side gives its points at a quarter and three quarters."""
    p = points.select("patch_id", "ring", "idx", "x", "y", _next("x").alias("x2"), _next("y").alias("y2"))
    cutp = lambda k, t: F.struct(F.lit(k).alias("k"), (F.col("x") * (1 - t) + F.col("x2") * t).alias("x"), (F.col("y") * (1 - t) + F.col("y2") * t).alias("y"))
    each = p.select("patch_id", "ring", "idx", F.explode(F.array(cutp(0, 0.25), cutp(1, 0.75))).alias("q"))
    return each.select("patch_id", "ring", (F.col("idx") * 2 + F.col("q.k")).alias("idx"), "q.x", "q.y")


def patch_convexity(labelled: DataFrame, res: float = 1.0, band: int = 1024) -> DataFrame:
    """Area over the area of the convex hull; NULL if the hull has none.  Only each row's first and last
    cell reach the hull; hulls of row bands are merged."""
    ends = labelled.groupBy("patch_id", "row").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))
    ends = cut(ends)
    corners = ends.select("patch_id", F.explode(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x in (F.col("c0"), F.col("c1") + 1) for y in (F.col("row"), F.col("row") + 1)))).alias("p")).select("patch_id", "p.x", "p.y")
    hulls = hull_area(corners, "patch_id", 1.0, band)
    return ends.groupBy("patch_id").agg(F.sum("n").alias("n")).join(hulls, "patch_id").select("patch_id", F.try_divide(F.col("n").cast("double"), "hull").alias("convexity"))


def ring_convexity(points: DataFrame, res: float = 1.0) -> DataFrame:
    """Convexity of smoothed rings."""
    hulls = hull_area(points.select("patch_id", "x", "y"), "patch_id", res)
    return ring_measures(points).join(hulls, "patch_id").select("patch_id", F.try_divide("superficie", "hull").alias("convexite"))


def simplify_rings(points: DataFrame, keep: float = 0.4, by: str | None = None) -> DataFrame:
    """Keeps a share of the removable corners of a layer (or of each tile `by`), those that carry most area; borders
    that patches share stay shared, and three corners of every ring stay, so no shape is lost."""
    return simplify(points, keep, by)


def rings_of(points: DataFrame) -> DataFrame:
    """(patch_id, xmin, ymin, xmax, ymax, rings) of ring points."""
    ring = points.groupBy("patch_id", "ring").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("p"), *(f(c).alias(n) for n, f, c in (("xmin", F.min, "x"), ("ymin", F.min, "y"), ("xmax", F.max, "x"), ("ymax", F.max, "y"))))
    points_of = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return ring.select("patch_id", points_of.alias("r"), "xmin", "ymin", "xmax", "ymax").groupBy("patch_id").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.collect_list("r").alias("rings"))


def rasterize_patches(polygons: DataFrame, res: float = 1.0, x_min: float = 0.0, y_max: float = 0.0) -> DataFrame:
    """(row, col, patch_id) of the cells whose centre is inside a polygon; of several the greatest id."""
    return burn(polygons, "patch_id", res, x_min, y_max).groupBy("row", "col").agg(F.max("patch_id").alias("patch_id"))


def rasterize_rings(points: DataFrame, res: float = 1.0, x_min: float = 0.0, y_max: float = 0.0) -> DataFrame:
    """As rasterize_patches, from ring points: no polygon is ever in one row or task."""
    sides = following(points.select("patch_id", "ring", "idx", "x", "y"), ["patch_id", "ring"])
    return burn_sides(sides, "patch_id", res, x_min, y_max).groupBy("row", "col").agg(F.max("patch_id").alias("patch_id"))


def near_patches(low: DataFrame, steep: DataFrame, distance: float, res: float = 1.0, by: tuple[str, ...] = (), low_by: tuple[str, ...] = (), steep_by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., low_by..., steep_by..., patch_id) of the low patches with a cell within `distance` of a steep cell (box to box, touching counts).

    low: by..., low_by..., patch_id, row, col.  steep: by..., steep_by..., row, col; the patches of every low_by meet the cells of every steep_by.  Steep cells are spread along their row as spans
    and each row in reach gets the span widened exactly, so the join is by row and column bucket;
    equal spans fold first."""
    k = int(distance / res) + 1
    # exact half width of the reach, for each difference of rows, in whole cells
    reach = [(d, int(np.floor(np.sqrt(max(distance**2 - (max(abs(d) - 1, 0) * res) ** 2, 0)) / res + 1e-9)) + 1) for d in range(-k, k + 1) if max(abs(d) - 1, 0) * res <= distance + 1e-9]
    mine = (*by, *steep_by)
    spans = runs(steep.withColumn("_one", F.lit(1)), "_one", 1, mine)
    wide = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in reach))).alias("s")
    zones = spans.select(*mine, "row", "c0", "c1", wide).select(*mine, (F.col("row") + F.col("s.d")).alias("row"), (F.col("c0") - F.col("s.w")).alias("c0"), (F.col("c1") + F.col("s.w")).alias("c1"))
    buckets = zones.select(*mine, "row", "c0", "c1", F.explode(F.sequence(F.floor(F.col("c0") / BUCKET), F.floor(F.col("c1") / BUCKET))).alias("_b"))
    clipped = buckets.select(*mine, "row", "_b", F.greatest("c0", F.col("_b") * BUCKET).alias("c0"), F.least("c1", F.col("_b") * BUCKET + BUCKET - 1).alias("c1")).distinct()
    asked = low.withColumn("_b", F.floor(F.col("col") / BUCKET))
    return asked.join(clipped, [*by, "row", "_b"]).where(F.col("col").between(F.col("c0"), F.col("c1"))).select(*by, *low_by, *steep_by, "patch_id").distinct()


def density_select(patches: DataFrame, low: float = 0.3, high: float = 0.6, column: str = "dens_mean") -> DataFrame:
    return patches.where(F.col(column).between(low, high))


def diagnostic_select(patches: DataFrame, largest: float = 1000.0, keep_flagged: bool = True) -> DataFrame:
    """Patches with any flag (or with none) and at most the largest area."""
    flags = [c for c in patches.columns if c.startswith("diag_")]
    anyone = reduce(lambda a, b: a | b, (F.coalesce(F.col(c) == 1, F.lit(False)) for c in flags), F.lit(False))
    return patches.where(anyone if keep_flagged else ~anyone).where(F.col("superficie") <= largest)


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """All layers' rows, repeated ones too."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)
