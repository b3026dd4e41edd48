"""The reference workflows as compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasol.functions import algebra as A
from terrasol.operators import focal as N
from terrasol.operators import forest as T
from terrasol.operators import grid as G
from terrasol.operators import patches as P
from terrasol.operators import windows as V
from terrasol.operators import zonal as Z
from terrasol.operators.topology import transformed
from terrasol.sources.store import cut


def geobia_zones(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """Object-based terraces: slope, aspect and position of every cell, their means per segment and its
    size in one aggregation, then the expert filter.  Elevations come in whole centimetres, so window
    sums are exact; slope and aspect share one set of neighbours."""
    gx, gy = N.gradients(res)
    direction = F.degrees(F.atan2(-gx, gy))
    elev = cells.select("row", "col", (F.col("elev_cm") / 100.0).alias("elev"))
    terrain = N.neighbours(elev, "elev").select(
        "row", "col", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope"), F.when((gx != 0) | (gy != 0), F.when(direction < 0, direction + 360).otherwise(direction)).alias("aspect")
    )
    position = N.tpi(cells, "elev_cm").select("row", "col", (F.col("tpi") / 100).alias("tpi"))
    zones = Z.zone_table(cells.select("row", "col", "zone_id").join(terrain, ["row", "col"]).join(position, ["row", "col"]), "zone_id", ["slope", "aspect", "tpi"])
    return Z.expert_filter(zones)


def geobia(cells: DataFrame) -> DataFrame:
    """1 on the cells of the kept segments, NULL elsewhere."""
    return Z.mask_zones(cells, "zone_id", geobia_zones(cells))


def terrace_patches(cells: DataFrame, ncols: int, threshold: float = 0.25, least: float = 10.0, largest: float = 1000.0, res: float = 1.0, partition_by_tile: bool = False, x_min: float = 700_000.0, y_max: float = 6_600_000.0) -> DataFrame:
    """From class probabilities (p1) and elevations to flagged patches: threshold, 5x5 majority, patches of eight
    neighbours, area, outline, simplified and smoothed rings, shape, statistics of the smoothed slope on the burnt
    polygons, flags, selection.  Rings are simplified and smoothed in degrees, and measured in Lambert-93 metres; the grid's north-west
    corner lies at (x_min, y_max) there.  With tiles (column `tile`), patches are cut at their borders."""
    by = ("tile",) if partition_by_tile else ()
    filtered = N.majority_filter(cells.select("row", "col", A.binarize(F.col("p1"), threshold).alias("one")), "one")
    if by:
        filtered = filtered.join(cells.select("row", "col", "tile"), ["row", "col"])
    labelled = P.label_runs(filtered, "mode", ncols, 8, by)
    if by:  # one number for patch and tile
        labelled = labelled.withColumn("patch_id", F.xxhash64("tile", "patch_id")).drop("tile")
    labelled = cut(labelled.join(P.min_area_filter(P.patch_area(labelled, res), least).select("patch_id"), "patch_id"))
    outlines = P.patch_outline(P.run_cells(labelled), res, x_min, y_max)
    rings = P.chaikin_rings(P.simplify_rings(transformed(outlines, A.to_wgs84)))
    rings = cut(transformed(rings, A.to_lambert93))
    shape = P.ring_measures(rings).join(P.ring_convexity(rings, res), "patch_id")
    smooth = N.focal_mean(N.slope(cells, "elev", res), "slope", 4, strict=False).select("row", "col", F.col("mean").alias("pente"))
    burnt = cut(P.rasterize_rings(rings, res, x_min, y_max).join(smooth, ["row", "col"]))
    means = Z.zonal_mean(burnt, "patch_id", ["pente"]).withColumnRenamed("pente", "pente_moyenne")
    tenths = Z.zonal_quantile(burnt, "patch_id", "pente").withColumnRenamed("quantile", "pente_decile10")
    full = Z.merge_zone_stats([shape, means, tenths], "patch_id", "left")
    flags = A.diagnostics(F.col("convexite"), F.col("pente_moyenne"), F.col("pente_decile10"))
    return P.diagnostic_select(full.select("patch_id", "superficie", "perimetre", "convexite", "pente_moyenne", "pente_decile10", *flags), largest)


def forest_levels(model: PipelineModel, tiles: list[DataFrame], values: list[float] | None = None) -> DataFrame:
    """From feature tiles to binary layers: class probabilities of every tile, mean where tiles overlap, one layer for each threshold."""
    whole = G.mosaic_mean([T.predict_cells(model, t) for t in tiles], ["p1"])
    return A.threshold_sweep(whole, "p1", values)


def fused_layers(layers: list[DataFrame], largest: float = 1000.0) -> DataFrame:
    """The flagged patches of every tile's layer, up to the largest area, as one layer."""
    return P.union_layers([P.diagnostic_select(layer, largest) for layer in layers])


def window_map(cells: DataFrame, bands: list[str], key_band: str, load: Callable[[], Callable], classes: int = 2, patch: int = 128, stride: int = 64) -> DataFrame:
    """(row, col, cls, p) by a user's window model: overlapping windows without bad data are scored, merged by Hann weights, and every cell
    takes its most probable class (0 and NULL where only weight 0 falls); cells of no scored window are absent."""
    windowed = cut(V.overlap_windows(cells, patch, stride))
    good = V.window_validity(windowed, bands, key_band).where("reason = 'ok'").select("i", "j")
    packed = V.pack_windows(windowed.join(good, ["i", "j"]), ["i", "j"], bands, (F.col("row") - F.col("i")) * patch + F.col("col") - F.col("j"))
    names = [f"p{k}" for k in range(classes)]
    merged = V.hann_merge(V.scored_cells(V.score_windows(packed, bands, classes, load, patch), patch, classes), names, patch)
    return merged.select("row", "col", A.argmax_class(names, 1, 0).alias("cls"), A.max_prob(names).alias("p"))
