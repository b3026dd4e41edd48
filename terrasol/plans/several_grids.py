"""Queries over several rasters in one table: the SQL is that of the single raster, once for each grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasol.operators import focal as N
from terrasol.operators import grid as G
from terrasol.operators import patches as P
from terrasol.plans import focal_queries, grid_queries, patch_queries  # noqa: F401  (their SQL is used)
from terrasol.plans.register import SQL, query
from terrasol.sources import derived as D


def each_grid(name: str) -> str:
    """SQL of a registered query on both grids."""
    one = SQL[name]
    return f"SELECT 'a' AS grid_id, * FROM ({one}) UNION ALL SELECT 'b' AS grid_id, * FROM ({one.replace(D.CELLS_SQL, D.CELLS_B_SQL)})"


def _elevation(spark, sf_dir):
    return D.two_grids(spark, sf_dir).withColumn("elev", F.col("elev_cm") / 100.0)


@query(each_grid("slope_with_edges"))
def grids_slope_with_edges(spark, sf_dir):
    return N.slope_with_edges(_elevation(spark, sf_dir)).withColumn("slope", F.round("slope", 6))


@query(each_grid("focal_mean"))
def grids_focal_mean(spark, sf_dir):
    mean = F.try_divide(F.col("total").cast("double"), F.col("n"))
    return N.box(D.two_grids(spark, sf_dir), "nir", 4).select("grid_id", "row", "col", F.when(F.col("n") == 81, mean).alias("strict"), mean.alias("lenient"))


@query(each_grid("focal_sd"))
def grids_focal_sd(spark, sf_dir):
    return N.focal_sd(D.two_grids(spark, sf_dir), "nir", 3, 1.0, 64).withColumn("sd", F.round("sd", 6))


@query(each_grid("majority_filter"))
def grids_majority_filter(spark, sf_dir):
    return N.majority_filter(D.two_grids(spark, sf_dir), "label")


@query(each_grid("distance_zone"))
def grids_distance_zone(spark, sf_dir):
    return N.distance_zone(D.two_grids(spark, sf_dir), F.col("nir") > 250, 5.0).withColumn("distance", F.round("distance", 6))


@query(each_grid("label_patches_4"))
def grids_label_patches(spark, sf_dir):
    return P.label_patches(D.two_grids(spark, sf_dir), "label", D.WIDTH, 4)


@query(each_grid("mosaic_mean"))
def grids_mosaic_mean(spark, sf_dir):
    c = D.two_grids(spark, sf_dir)
    return G.mosaic_mean([c.where("col < 60").select("grid_id", "row", "col", F.col("nir").alias("v")), c.where("col >= 40").select("grid_id", "row", "col", F.col("red").alias("v"))], ["v"])


# grid b lies 1,000 m east and 500 m south of grid a; the tiles of both lie in one table
@query(f"""WITH {D.CELLS_SQL}, {D.TILES_SQL}, g AS (SELECT 'a' AS grid_id, r, c, nir, c + 0.5 AS x, -(r + 0.5) AS y FROM cells UNION ALL SELECT 'b', r, 99 - c, nir, 1000 + (99 - c) + 0.5, -500 - (r + 0.5) FROM cells WHERE r % 11 <> 5),
t AS (SELECT * FROM tiles UNION ALL SELECT 'S' || name, xmin + 1000, ymin - 500, xmax + 1000, ymax - 500 FROM tiles)
SELECT name AS tile, grid_id, r AS "row", c AS "col", nir FROM g JOIN t ON x >= xmin AND x < xmax AND y > ymin AND y <= ymax""")
def grids_assign_tiles(spark, sf_dir):
    near = D.tiles(spark, sf_dir)
    far = near.select(F.concat(F.lit("S"), "name").alias("name"), *((F.col(c) + (1000.0 if c[0] == "x" else -500.0)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    lie = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 1000.0, -500.0, 1.0, 1.0)], "grid_id string, x_min double, y_max double, res_x double, res_y double")
    return G.assign_tiles(D.two_grids(spark, sf_dir).select("grid_id", "row", "col", "nir"), near.unionByName(far), geometry=lie)
