"""Queries of neighbourhoods, zones and the object-based workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasol.functions import algebra as A
from terrasol.operators import focal as N
from terrasol.operators import zonal as Z
from terrasol.plans.pipelines import geobia_zones
from terrasol.plans.register import query
from terrasol.sources import derived as D
from terrasol.sources.store import cut

CELLS = D.CELLS_SQL
RC = 'r AS "row", c AS "col"'

#: z in metres with its eight neighbours
NB = f"""{CELLS}, z AS (SELECT r, c, elev_cm / 100.0::DOUBLE AS z FROM cells),
nb AS (SELECT m.r, m.c, m.z, n.z AS n, s.z AS s, w.z AS w, e.z AS e, nw.z AS nw, ne.z AS ne, sw.z AS sw, se.z AS se FROM z m
 LEFT JOIN z n ON n.r = m.r - 1 AND n.c = m.c LEFT JOIN z s ON s.r = m.r + 1 AND s.c = m.c LEFT JOIN z w ON w.r = m.r AND w.c = m.c - 1 LEFT JOIN z e ON e.r = m.r AND e.c = m.c + 1
 LEFT JOIN z nw ON nw.r = m.r - 1 AND nw.c = m.c - 1 LEFT JOIN z ne ON ne.r = m.r - 1 AND ne.c = m.c + 1 LEFT JOIN z sw ON sw.r = m.r + 1 AND sw.c = m.c - 1 LEFT JOIN z se ON se.r = m.r + 1 AND se.c = m.c + 1)"""
GRAD = "((ne + 2 * e + se) - (nw + 2 * w + sw)) / 8 AS gx, ((sw + 2 * s + se) - (nw + 2 * n + ne)) / 8 AS gy"
SLOPE = f"{NB}, g AS (SELECT r, c, z, {GRAD} FROM nb), slope AS (SELECT r, c, z, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, CASE WHEN gx <> 0 OR gy <> 0 THEN CASE WHEN atan2(-gx, gy) < 0 THEN degrees(atan2(-gx, gy)) + 360 ELSE degrees(atan2(-gx, gy)) END END AS aspect FROM g)"


def elevation(spark, sf_dir):
    return D.cells(spark, sf_dir).withColumn("elev", F.col("elev_cm") / 100.0)


@query(f"WITH {SLOPE} SELECT {RC}, round(slope, 6) AS slope FROM slope")
def slope(spark, sf_dir):
    return N.slope(elevation(spark, sf_dir)).withColumn("slope", F.round("slope", 6))


def _edge(name, row_edge, col_edge, corner, across_row, across_col):
    """A neighbour, or what goes on straight beyond the grid's edge, or the cell itself."""
    cases = [f"WHEN {row_edge} AND {col_edge} THEN 2 * z - {corner}" if row_edge and col_edge else "", f"WHEN {row_edge} THEN 2 * {across_row[0]} - {across_row[1]}" if row_edge else "", f"WHEN {col_edge} THEN 2 * {across_col[0]} - {across_col[1]}" if col_edge else ""]
    return f"coalesce({name}, CASE {' '.join(cases)} END, z) AS {name}"


TOP, BOTTOM, LEFT, RIGHT = "r = r0", "r = r1", "c = c0", "c = c1"
EDGES = ", ".join(
    [
        _edge("n", TOP, "", "", ("z", "s"), ()),
        _edge("s", BOTTOM, "", "", ("z", "n"), ()),
        _edge("w", "", LEFT, "", (), ("z", "e")),
        _edge("e", "", RIGHT, "", (), ("z", "w")),
        _edge("nw", TOP, LEFT, "se", ("w", "sw"), ("n", "ne")),
        _edge("ne", TOP, RIGHT, "sw", ("e", "se"), ("n", "nw")),
        _edge("sw", BOTTOM, LEFT, "ne", ("w", "nw"), ("s", "se")),
        _edge("se", BOTTOM, RIGHT, "nw", ("e", "ne"), ("s", "sw")),
    ]
)
EDGE_SLOPE = f"{NB}, x AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM z), ed AS (SELECT r, c, z, {EDGES} FROM nb, x), eg AS (SELECT r, c, {GRAD} FROM ed), eslope AS (SELECT r, c, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM eg)"


@query(f"WITH {EDGE_SLOPE} SELECT {RC}, round(slope, 6) AS slope FROM eslope")
def slope_with_edges(spark, sf_dir):
    return N.slope_with_edges(elevation(spark, sf_dir)).withColumn("slope", F.round("slope", 6))


@query(f"WITH {SLOPE} SELECT {RC}, round(aspect, 6) + 0.0 AS aspect FROM slope")
def aspect(spark, sf_dir):
    return N.aspect(elevation(spark, sf_dir)).withColumn("aspect", F.round("aspect", 6))


def box_sql(table: str, band: str, half: int) -> str:
    """Sum and count in squares, by two passes over indices."""
    return f"""bl AS (SELECT a.r, a.c, any_value(a.{band}) AS v, sum(b.{band}) AS s, count(b.{band}) AS n FROM {table} a JOIN {table} b ON a.r = b.r AND b.c BETWEEN a.c - {half} AND a.c + {half} GROUP BY a.r, a.c),
box AS (SELECT a.r, a.c, any_value(a.v) AS v, sum(b.s) AS s, sum(b.n) AS n FROM bl a JOIN bl b ON a.c = b.c AND b.r BETWEEN a.r - {half} AND a.r + {half} GROUP BY a.r, a.c)"""


@query(f"WITH {CELLS}, {box_sql('cells', 'nir', 4)} SELECT {RC}, CASE WHEN n = 81 THEN s::DOUBLE / n END AS strict, CASE WHEN n > 0 THEN s::DOUBLE / n END AS lenient FROM box")
def focal_mean(spark, sf_dir):
    c = D.cells(spark, sf_dir)
    return N.box(c, "nir", 4).select("row", "col", F.when(F.col("n") == 81, F.try_divide(F.col("total").cast("double"), F.col("n"))).alias("strict"), F.try_divide(F.col("total").cast("double"), F.col("n")).alias("lenient"))


@query(f"WITH {CELLS}, {box_sql('cells', 'elev_cm', 4)} SELECT {RC}, CASE WHEN n = 81 THEN round(v - s::DOUBLE / n, 6) END AS tpi FROM box")
def tpi(spark, sf_dir):
    return N.tpi(D.cells(spark, sf_dir), "elev_cm").withColumn("tpi", F.round("tpi", 6))


CIRCLE = "o AS (SELECT dr, dc FROM (SELECT unnest(range(-3, 4)) AS dr), (SELECT unnest(range(-3, 4)) AS dc) WHERE dr * dr + dc * dc <= 9)"


@query(f"WITH {CELLS}, {CIRCLE} SELECT a.r AS \"row\", a.c AS \"col\", round(stddev_samp(b.nir), 6) AS sd FROM cells a, o LEFT JOIN cells b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c")
def focal_sd(spark, sf_dir):
    return N.focal_sd(D.cells(spark, sf_dir), "nir", 3, 1.0, 64).withColumn("sd", F.round("sd", 6))


@query(f"WITH {CELLS}, {CIRCLE} SELECT a.r AS \"row\", a.c AS \"col\", CASE WHEN any_value(a.nir) IS NOT NULL THEN CAST(coalesce(sum(abs(b.nir - a.nir)), 0) AS DOUBLE) END AS tri FROM cells a, o LEFT JOIN cells b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c")
def focal_tri(spark, sf_dir):
    return N.focal_tri(D.cells(spark, sf_dir), "nir", 3, 1.0, 64)


@query(f"WITH {CELLS}, {box_sql('cells', 'label', 2)} SELECT {RC}, CASE WHEN n > 0 THEN CASE WHEN 2 * s > n THEN 1 ELSE 0 END END AS mode FROM box")
def majority_filter(spark, sf_dir):
    return N.majority_filter(D.cells(spark, sf_dir), "label")


@query(f"""WITH {CELLS}, v AS (SELECT a.r, a.c, b.nir % 5 AS v, count(*) AS n FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.r BETWEEN a.r - 1 AND a.r + 1 WHERE b.nir IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT r, c, v, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, v) AS k FROM v) SELECT cells.r AS "row", cells.c AS "col", k.v AS mode FROM cells LEFT JOIN k ON k.r = cells.r AND k.c = cells.c AND k.k = 1""")
def mode_filter(spark, sf_dir):
    return N.mode_filter(D.cells(spark, sf_dir).withColumn("v", F.col("nir") % 5), "v", 1)


@query(f"WITH {CELLS}, st AS (SELECT r, c, CASE WHEN nir >= 120 THEN 1 WHEN nir IS NOT NULL THEN 0 END AS steep FROM cells), {box_sql('st', 'steep', 4)} SELECT {RC}, CASE WHEN n > 0 THEN s::DOUBLE / n END AS density FROM box")
def local_density(spark, sf_dir):
    c = D.cells(spark, sf_dir).withColumn("steep", A.binarize(F.col("nir"), 120))
    return N.local_density(c, "steep", half=4)


@query(f"""WITH {CELLS}, src AS (SELECT r, c FROM cells WHERE nir > 250), d AS (SELECT a.r, a.c, min(sqrt((a.r - s.r) * (a.r - s.r) + (a.c - s.c) * (a.c - s.c))) AS d FROM cells a LEFT JOIN src s ON s.r BETWEEN a.r - 5 AND a.r + 5 AND s.c BETWEEN a.c - 5 AND a.c + 5 GROUP BY a.r, a.c)
SELECT {RC}, CASE WHEN d < 5 THEN round(d, 6) END AS distance, CASE WHEN d < 5 THEN 1 ELSE 0 END AS zone FROM d""")
def distance_zone(spark, sf_dir):
    return N.distance_zone(D.cells(spark, sf_dir), F.col("nir") > 250, 5.0).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {CELLS}, src AS (SELECT r, c FROM cells WHERE nir > 290), d AS (SELECT a.r, a.c, min((a.r - s.r) * (a.r - s.r) + (a.c - s.c) * (a.c - s.c)) AS d FROM cells a LEFT JOIN src s ON s.r BETWEEN a.r - 150 AND a.r + 150 GROUP BY a.r, a.c)
SELECT {RC}, CASE WHEN d < 22500 THEN round(sqrt(d), 6) END AS distance, CASE WHEN d < 22500 THEN 1 ELSE 0 END AS zone FROM d""")
def distance_zone_far(spark, sf_dir):
    """The default reach of 150 m, from few sources."""
    return N.distance_zone(D.cells(spark, sf_dir), F.col("nir") > 290).withColumn("distance", F.round("distance", 6))


@query(f"WITH {CELLS} SELECT zone_id, avg(nir) AS nir, avg(red) AS red, avg(elev_cm) AS elev_cm FROM cells GROUP BY zone_id")
def zonal_mean(spark, sf_dir):
    return Z.zonal_mean(D.cells(spark, sf_dir), "zone_id", ["nir", "red", "elev_cm"])


@query(f"WITH {CELLS} SELECT zone_id, round(quantile_cont(nir::DOUBLE, 0.1), 6) AS quantile FROM cells GROUP BY zone_id")
def zonal_quantile(spark, sf_dir):
    return Z.zonal_quantile(D.cells(spark, sf_dir), "zone_id", "nir").withColumn("quantile", F.round("quantile", 6))


@query(f"WITH {CELLS} SELECT r % 2 AS zone, round(quantile_cont(CASE WHEN r % 2 = 0 THEN nir ELSE red * 1000000 + nir END::DOUBLE, 0.37), 6) AS quantile FROM cells GROUP BY 1")
def quantile_of_huge_zones(spark, sf_dir):
    """Two zones that hold half of the grid each, narrowed down to ranges of a hundred values."""
    c = D.cells(spark, sf_dir).select((F.col("row") % 2).alias("zone"), F.when(F.col("row") % 2 == 0, F.col("nir")).otherwise(F.col("red") * 1_000_000 + F.col("nir")).alias("v"))
    return Z.zonal_quantile(cut(c), "zone", "v", 0.37, few=100).withColumn("quantile", F.round("quantile", 6))


@query(f"WITH {CELLS} SELECT zone_id, count(nir) AS dens_count, CAST(sum(nir) AS BIGINT) AS dens_sum, avg(nir) AS dens_mean FROM cells GROUP BY zone_id")
def zonal_stats(spark, sf_dir):
    return Z.zonal_stats(D.cells(spark, sf_dir), "zone_id", "nir")


@query(f"WITH {CELLS} SELECT zone_id, count(*) AS pixels FROM cells GROUP BY zone_id")
def zone_sizes(spark, sf_dir):
    return Z.zone_sizes(D.cells(spark, sf_dir), "zone_id")


@query(f"WITH {CELLS} SELECT zone_id, a.nir, b.quantile FROM (SELECT zone_id, avg(nir) AS nir FROM cells GROUP BY 1) a LEFT JOIN (SELECT zone_id, round(quantile_cont(red::DOUBLE, 0.1), 6) AS quantile FROM cells WHERE c < 50 GROUP BY 1) b USING (zone_id)")
def merge_zone_stats(spark, sf_dir):
    c = D.cells(spark, sf_dir)
    b = Z.zonal_quantile(c.where("col < 50"), "zone_id", "red").withColumn("quantile", F.round("quantile", 6))
    return Z.merge_zone_stats([Z.zonal_mean(c, "zone_id", ["nir"]), b], "zone_id", "left")


GEOBIA = f"""{SLOPE}, {box_sql('z', 'z', 4)}, ec AS (SELECT a.r, a.c, sum(b.elev_cm) AS s, count(*) AS n FROM (SELECT r, c FROM cells) a JOIN (SELECT r, c, elev_cm FROM cells) b ON b.r BETWEEN a.r - 4 AND a.r + 4 AND b.c BETWEEN a.c - 4 AND a.c + 4 GROUP BY 1, 2),
zt AS (SELECT zone_id, avg(slope) AS slope, avg(aspect) AS aspect, avg(CASE WHEN n = 81 THEN (elev_cm - s::DOUBLE / n) / 100 END) AS tpi, count(*) AS pixels FROM cells JOIN slope USING (r, c) JOIN ec USING (r, c) GROUP BY zone_id),
kept AS (SELECT * FROM zt WHERE slope > 4 AND slope < 16 AND aspect > 130 AND aspect < 240 AND tpi > 0.05 AND tpi < 0.7 AND pixels > 5 AND pixels < 2000)"""


@query(f"WITH {GEOBIA} SELECT zone_id, round(slope, 6) AS slope, round(aspect, 6) AS aspect, round(tpi, 6) AS tpi, pixels FROM kept", name="geobia")
def geobia(spark, sf_dir):
    out = geobia_zones(D.cells(spark, sf_dir))
    return out.select("zone_id", *(F.round(c, 6).alias(c) for c in ("slope", "aspect", "tpi")), "pixels")


@query(f"WITH {CELLS}, zt AS (SELECT zone_id, avg(nir) / 10 AS slope, avg(red) * 5 AS aspect, avg(label) AS tpi, count(*) AS pixels FROM cells GROUP BY 1) SELECT zone_id, pixels FROM zt WHERE slope > 4 AND slope < 16 AND aspect > 130 AND aspect < 240 AND tpi > 0.05 AND tpi < 0.7 AND pixels > 5 AND pixels < 2000")
def expert_filter(spark, sf_dir):
    zt = D.cells(spark, sf_dir).groupBy("zone_id").agg((F.avg("nir") / 10).alias("slope"), (F.avg("red") * 5).alias("aspect"), F.avg("label").alias("tpi"), F.count("*").alias("pixels"))
    return Z.expert_filter(zt).select("zone_id", "pixels")


@query(f"WITH {CELLS}, k AS (SELECT zone_id FROM cells GROUP BY 1 HAVING avg(nir) > 120) SELECT {RC}, CASE WHEN zone_id IN (SELECT zone_id FROM k) THEN 1 END AS value FROM cells")
def mask_zones(spark, sf_dir):
    c = D.cells(spark, sf_dir)
    return Z.mask_zones(c, "zone_id", Z.zonal_mean(c, "zone_id", ["nir"]).where("nir > 120"))


@query(f"WITH {CELLS} SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(label) FROM cells), 2) AS percent FROM cells WHERE label IS NOT NULL GROUP BY label")
def class_distribution(spark, sf_dir):
    return Z.class_distribution(D.cells(spark, sf_dir), "label")


@query(f"WITH {CELLS} SELECT round(count(*) FILTER (label = 1)::DOUBLE / count(*) FILTER (label = 0), 3) AS ratio, count(label) AS cells, count(DISTINCT nullif(label, 0)) AS classes FROM cells")
def class_ratio(spark, sf_dir):
    return Z.class_ratio(D.cells(spark, sf_dir), "label")


@query(f"WITH {CELLS} SELECT count(*) FILTER (nir IS NULL) AS missing, min(nir) AS least, max(nir) AS most, round(avg(nir), 6) AS mean, count(nir) AS covered, round(count(nir) * 100.0::DOUBLE / count(*), 2) AS percent FROM cells")
def raster_stats(spark, sf_dir):
    return Z.raster_stats(D.cells(spark, sf_dir), "nir")


@query(f"WITH {CELLS}, p AS (SELECT zone_id, count(*) * 0.25::DOUBLE AS area FROM cells GROUP BY 1) SELECT round(sum(area), 2) AS total_area FROM p")
def total_area(spark, sf_dir):
    return Z.total_area(D.cells(spark, sf_dir).groupBy("zone_id").agg((F.count("*") * 0.25).alias("area")))


@query(f"""WITH {CELLS} SELECT r // 32 AS layer, count(*) AS rows_in, count(*) - count(*) FILTER (label = 1) AS removed_flag, count(*) FILTER (label = 1) AS left_flag,
count(*) FILTER (label = 1) - count(*) FILTER (label = 1 AND nir <= 150) AS removed_area, count(*) FILTER (label = 1 AND nir <= 150) AS left_area FROM cells GROUP BY 1""")
def filter_report(spark, sf_dir):
    c = D.cells(spark, sf_dir).withColumn("layer", F.floor(F.col("row") / 32).cast("int"))
    return Z.filter_report(c, "layer", {"flag": F.col("label") == 1, "area": F.col("nir") <= 150})
