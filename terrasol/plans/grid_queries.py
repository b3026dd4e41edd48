"""Queries of sources, map algebra and grid geometry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasol.functions import algebra as A
from terrasol.operators import grid as G
from terrasol.plans.register import query
from terrasol.sources import cells as C
from terrasol.sources import derived as D
from terrasol.sources.store import new_path

CELLS, PROB, EMB, TILES = D.CELLS_SQL, D.PROB_SQL, D.EMB_SQL, D.TILES_SQL
RC = 'r AS "row", c AS "col"'


@query(f'WITH {EMB} SELECT {RC.replace("c AS", "CAST(c AS INT) AS")}, CASE WHEN isnan(v) THEN NULL ELSE v END AS v FROM emb')
def read_cells(spark, sf_dir):
    path = new_path(spark)
    C.write_cells(D.embedding_grid(spark, sf_dir), path)
    return C.read_cells(spark, path, ["v"])


PATHS = "paths AS (SELECT '/data/' || format('T{:02d}_{:02d}', r // 32, c // 64) || '/' || CASE WHEN (r * 100 + c) % 4 = 0 THEN 'rf_' WHEN (r * 100 + c) % 4 = 1 THEN 'mnt_' WHEN (r * 100 + c) % 4 = 2 THEN 'ortho_' ELSE 'pt_' END || r || '_' || c || CASE WHEN c % 3 = 0 THEN '.gpkg' ELSE '.tif' END AS path FROM cells)"


def _paths(spark, sf_dir):
    c = D.cells(spark, sf_dir)
    k = (F.col("row") * 100 + F.col("col")) % 4
    kind = F.when(k == 0, "rf_").when(k == 1, "mnt_").when(k == 2, "ortho_").otherwise("pt_")
    tile = F.format_string("T%02d_%02d", F.floor(F.col("row") / 32), F.floor(F.col("col") / 64))
    return c.select(F.concat(F.lit("/data/"), tile, F.lit("/"), kind, "row", F.lit("_"), "col", F.when(F.col("col") % 3 == 0, ".gpkg").otherwise(".tif")).alias("path"))


@query(f"WITH {CELLS}, {PATHS} SELECT split_part(path, '/', 3) AS tile, min(path) AS path FROM paths WHERE regexp_matches(split_part(path, '/', 4), '^rf_.*\\.tif$') GROUP BY 1")
def discover_tiles(spark, sf_dir):
    return C.discover_tiles(_paths(spark, sf_dir), r"^rf_.*\.tif$")


@query(f"WITH {CELLS}, {PATHS} SELECT DISTINCT split_part(path, '/', 3) AS tile FROM paths WHERE split_part(path, '/', 3) NOT IN (SELECT split_part(path, '/', 3) FROM paths WHERE regexp_matches(split_part(path, '/', 4), '^rf_11_'))")
def tiles_without(spark, sf_dir):
    return C.tiles_without(_paths(spark, sf_dir), "^rf_11_")


LEGEND = "legend AS (SELECT CAST(n_nationkey AS INT) AS value, CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS class_id, n_name AS label, CAST(n_nationkey * 7 % 256 AS INT) AS r, CAST(n_nationkey * 11 % 256 AS INT) AS g, CAST(n_nationkey * 13 % 256 AS INT) AS b FROM nation)"


def _legend(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    color = F.concat(F.lit("#"), *(F.lpad(F.hex(F.col("n_nationkey") * m % 256), 2, "0") for m in (7, 11, 13)))
    each = n.agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("int").alias("v"), color.alias("p"), F.col("n_name").alias("l")))).alias("e"))
    return each.select(F.transform("e", lambda x: x["v"]).alias("values"), F.transform("e", lambda x: x["p"]).alias("palette"), F.transform("e", lambda x: x["l"]).alias("label"))


@query(f"WITH {LEGEND} SELECT value, class_id, label, r, g, b FROM legend")
def read_legend(spark, sf_dir):
    path = new_path(spark)
    _legend(spark, sf_dir).write.json(path)
    return C.read_legend(spark, path)


@query(f'WITH {CELLS} SELECT {RC}, nir, red, zone_id FROM cells')
def write_cells(spark, sf_dir):
    path = new_path(spark)
    C.write_cells(D.cells(spark, sf_dir).select("row", "col", "nir", "red", "zone_id", F.floor(F.col("row") / 512).alias("band_row")), path, ("band_row",))
    return spark.read.parquet(path).select("row", "col", "nir", "red", "zone_id")


@query(f"WITH {CELLS} SELECT zone_id AS patch_id, CAST(count(*) AS DOUBLE) AS superficie FROM cells GROUP BY zone_id")
def write_patches(spark, sf_dir):
    path = new_path(spark)
    C.write_patches(D.cells(spark, sf_dir).groupBy(F.col("zone_id").alias("patch_id")).agg(F.count("*").cast("double").alias("superficie")), path)
    return C.read_patches(spark, path)


@query(f"""WITH {CELLS}, o AS (SELECT r // 32 AS t, count(*) AS n, sum(CASE WHEN nir IS NULL THEN 1 ELSE 0 END) AS missing FROM cells GROUP BY 1)
SELECT CASE WHEN missing > 60 THEN 'ERREUR' ELSE 'OK' END AS status, count(*) AS tiles, CAST(coalesce(sum(CASE WHEN missing > 60 THEN NULL ELSE n END), 0) AS BIGINT) AS items FROM o GROUP BY 1""")
def tile_report(spark, sf_dir):
    def work(data):
        if data["nir"].null_count > 60:
            raise ValueError("too much NoData")
        return data.num_rows

    tiled = D.cells(spark, sf_dir).select(F.floor(F.col("row") / 32).cast("string").alias("tile"), "nir")
    return C.tile_report(C.per_tile(tiled, "tile", work))


@query(f'WITH {CELLS} SELECT {RC}, elev_cm FROM cells WHERE r BETWEEN 3 AND 40 AND c BETWEEN 10 AND 29')
def crop(spark, sf_dir):
    return G.crop(D.cells(spark, sf_dir).select("row", "col", "elev_cm"), 3, 40, 10, 29)


INSIDE = "c + 0.5 >= xmin AND c + 0.5 < xmax AND -(r + 0.5) > ymin AND -(r + 0.5) <= ymax"


@query(f'WITH {CELLS}, {TILES} SELECT name AS tile, {RC}, elev_cm FROM cells JOIN tiles ON {INSIDE}')
def assign_tiles(spark, sf_dir):
    return G.assign_tiles(D.cells(spark, sf_dir).select("row", "col", "elev_cm"), D.tiles(spark, sf_dir))


BOXES = "name IN ('T00_00', 'T02_01', 'T04_00')"


@query(f'WITH {CELLS}, {TILES} SELECT {RC}, CASE WHEN EXISTS (SELECT 1 FROM tiles WHERE {BOXES} AND {INSIDE}) THEN elev_cm END AS elev_cm FROM cells')
def mask_by_polygon(spark, sf_dir):
    return G.mask_by_boxes(D.cells(spark, sf_dir).select("row", "col", "elev_cm"), D.tiles(spark, sf_dir).where(BOXES), ["elev_cm"])


@query(f'WITH {CELLS}, {TILES} SELECT {RC}, CASE WHEN EXISTS (SELECT 1 FROM tiles WHERE {BOXES} AND {INSIDE}) THEN elev_cm END AS elev_cm FROM cells')
def mask_by_ring(spark, sf_dir):
    """The same boxes as polygons, by ray casting."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax")))
    return G.mask_by_polygon(D.cells(spark, sf_dir).select("row", "col", "elev_cm"), D.tiles(spark, sf_dir).where(BOXES).withColumn("rings", ring), ["elev_cm"])


@query(f'WITH {CELLS} SELECT {RC}, CASE WHEN label = 0 THEN NULL ELSE nir END AS nir, red FROM cells')
def mask_by_raster(spark, sf_dir):
    c = D.cells(spark, sf_dir)
    return G.mask_by_raster(c.select("row", "col", "nir", "red"), c.select("row", "col", "label"), "label", ["nir"])


@query(f"WITH {CELLS}, {TILES}, {PATHS} SELECT name, (SELECT min(path) FROM paths WHERE contains(path, name)) AS path FROM tiles")
def match_tile_image(spark, sf_dir):
    return G.match_tile_image(D.tiles(spark, sf_dir), _paths(spark, sf_dir))


@query("""WITH t AS (SELECT 'D' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS name, o_orderkey AS k FROM orders),
p AS (SELECT '/images/' || name || '/' || (k % 5) || '.tif' AS path, name FROM t WHERE k % 3 <> 0 UNION ALL SELECT '/archive/x' || name || 'y.tif', name FROM t WHERE k % 4 = 0)
SELECT t.name, (SELECT min(path) FROM p WHERE p.name = t.name AND contains(path, t.name)) AS path FROM t""")
def match_many_tiles(spark, sf_dir):
    """A tile name for every order, most of them in one or two paths."""
    k = F.col("o_orderkey")
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("D"), F.lpad(k.cast("string"), 7, "0")).alias("name"), k.alias("k"))
    first = t.where("k % 3 <> 0").select(F.concat(F.lit("/images/"), "name", F.lit("/"), (F.col("k") % 5).cast("string"), F.lit(".tif")).alias("path"))
    second = t.where("k % 4 = 0").select(F.concat(F.lit("/archive/x"), "name", F.lit("y.tif")).alias("path"))
    return G.match_tile_image(t, first.unionByName(second))


@query(f"""WITH {CELLS}, {TILES} SELECT 'tile=' || name AS tile, 'OK' AS status, count(*) AS n FROM cells JOIN tiles ON c + 0.5 >= xmin AND c + 0.5 < xmax AND -(r + 0.5) > ymin AND -(r + 0.5) <= ymax GROUP BY name
UNION ALL SELECT 'tile=broken', 'ERREUR', NULL UNION ALL SELECT 'tile=none', 'MANQUANT', NULL""")
def file_outcomes(spark, sf_dir):
    """Tiles written as files and found again in their folders; one folder holds a file that is no Parquet, one no tile."""
    folder = new_path(spark)
    tiled = G.assign_tiles(D.cells(spark, sf_dir).select("row", "col", "nir"), D.tiles(spark, sf_dir))
    tiled.repartition("tile").write.partitionBy("tile").parquet(folder)
    note = spark.range(1).select(F.lit("cut off").alias("value"))
    note.write.text(f"{folder}/tile=broken")
    note.write.json(f"{folder}/tile=none")
    return C.file_outcomes(spark, folder, r"^part-.*(parquet|txt)$").select("tile", "status", "n")


@query(f'WITH {CELLS} SELECT {RC}, nir AS b1, red AS b2, elev_cm AS b4 FROM cells')
def select_bands(spark, sf_dir):
    return G.select_bands(D.cells(spark, sf_dir), {"nir": "b1", "red": "b2", "elev_cm": "b4"})


# target cells of 2 m whose centres lie 0.25 m beside the source's corners
@query(f"""WITH {CELLS}, t AS (SELECT r AS trow, c AS tcol, c * 2 + 1.25::DOUBLE AS x, -(r * 2 + 0.75::DOUBLE) AS y FROM cells WHERE r < (SELECT max(r) // 2 FROM cells) AND c < 50),
k AS (SELECT trow, tcol, floor(-y - 0.5) AS fr, floor(x - 0.5) AS fc, (-y - 0.5) - floor(-y - 0.5) AS v, (x - 0.5) - floor(x - 0.5) AS u FROM t),
q AS (SELECT trow, tcol, fr + dr AS rr, fc + dc AS cc, (CASE WHEN dr = 1 THEN v ELSE 1 - v END) * (CASE WHEN dc = 1 THEN u ELSE 1 - u END) AS w FROM k, (SELECT unnest([0, 0, 1, 1]) AS dr, unnest([0, 1, 0, 1]) AS dc))
SELECT trow, tcol, CASE WHEN count(elev_cm) = count(*) THEN round(sum(w * elev_cm), 6) END AS elev_cm FROM q LEFT JOIN cells ON r = rr AND c = cc WHERE w > 0 GROUP BY trow, tcol""")
def resample_bilinear(spark, sf_dir):
    c = D.cells(spark, sf_dir)
    last = F.broadcast(c.agg(F.floor(F.max("row") / 2).alias("last")))
    target = c.crossJoin(last).where("row < last and col < 50").select(F.col("row").alias("trow"), F.col("col").alias("tcol"), (F.col("col") * 2 + 1.25).alias("x"), (-(F.col("row") * 2 + 0.75)).alias("y"))
    return G.resample_bilinear(c, "elev_cm", target).withColumn("elev_cm", F.round("elev_cm", 6))


@query(f"WITH {CELLS} SELECT CAST(min(c) AS DOUBLE) AS x_min, CAST(-min(r) AS DOUBLE) AS y_max, 1.0::DOUBLE AS res_x, 1.0::DOUBLE AS res_y, max(r) - min(r) + 1 AS nrows, max(c) - min(c) + 1 AS ncols, 'EPSG:2154' AS crs, true AS same FROM cells")
def same_grid(spark, sf_dir):
    a = G.grid_of(D.cells(spark, sf_dir))
    G.require_resolution(a)
    same = G.same_grid(a, G.grid_of(D.probabilities(spark, sf_dir)))
    return a.withColumns({"x_min": F.col("x_min") + 0.0, "y_max": F.col("y_max") + 0.0, "same": F.lit(same)})


@query(f'WITH {CELLS}, {PROB} SELECT coalesce(a.r, p.r) AS "row", coalesce(a.c, p.c) AS "col", nir, p1 FROM (SELECT * FROM cells WHERE c < 60) a FULL JOIN (SELECT * FROM prob WHERE c > 40) p ON a.r = p.r AND a.c = p.c')
def stack_bands(spark, sf_dir):
    return G.stack_bands([D.cells(spark, sf_dir).where("col < 60").select("row", "col", "nir"), D.probabilities(spark, sf_dir).where("col > 40").select("row", "col", "p1")])


def strips_sql(count: int, overlap: int) -> str:
    """Strips in whole patches of 4 over the table's own extent."""
    return f"""WITH {CELLS}, e AS (SELECT max(c) + 1 AS w, max(r) + 1 AS h FROM cells),
k AS (SELECT w, h // 4 * 4 AS high, (w - {overlap * (count + 1)}) // {count + 2} // 4 * 4 AS wide FROM e),
st AS (SELECT s, greatest(0, least(s * (wide - {overlap}), w - wide)) AS o, wide, high FROM k, (SELECT unnest(range(0, {count})) AS s))
SELECT CAST(s AS INT) AS strip, r AS "row", CAST(c - o AS INT) AS "col", nir FROM cells, st WHERE c >= o AND c < o + wide AND r < high"""


def _strips(spark, sf_dir, count, overlap):
    c = D.cells(spark, sf_dir).select("row", "col", "nir")
    size = c.agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height")).first()
    return G.split_strips(c, size.width or 0, size.height or 0, count, overlap, 4)


@query(strips_sql(5, 2))
def split_strips(spark, sf_dir):
    return _strips(spark, sf_dir, 5, 2)


@query(strips_sql(3, 4))
def split_strips_extent(spark, sf_dir):
    return _strips(spark, sf_dir, 3, 4)


@query(f'WITH {CELLS} SELECT r AS "row", c AS "col", avg(v) AS v FROM (SELECT r, c, nir AS v FROM cells WHERE c < 60 UNION ALL SELECT r, c, red AS v FROM cells WHERE c >= 40) GROUP BY r, c')
def mosaic_mean(spark, sf_dir):
    c = D.cells(spark, sf_dir)
    return G.mosaic_mean([c.where("col < 60").select("row", "col", F.col("nir").alias("v")), c.where("col >= 40").select("row", "col", F.col("red").alias("v"))], ["v"])


@query(f"WITH {CELLS}, {TILES} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, CAST(ceil((max(xmax) - min(xmin)) / 0.7) AS INT) AS ncols, CAST(ceil((max(ymax) - min(ymin)) / 0.7) AS INT) AS nrows FROM tiles")
def mosaic_extent(spark, sf_dir):
    out = G.mosaic_extent(D.tiles(spark, sf_dir), 0.7)
    return out.select(*((F.col(c) + 0.0).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), "ncols", "nrows")


@query(f"WITH {CELLS}, {TILES} SELECT name, CAST(trunc(((SELECT max(ymax) FROM tiles) - ymax) / 0.7) AS INT) AS row_off, CAST(trunc((xmin - (SELECT min(xmin) FROM tiles)) / 0.7) AS INT) AS col_off, CAST(round_even((xmin - (SELECT min(xmin) FROM tiles)) / 0.7, 0) AS INT) AS col_round FROM tiles")
def tile_offsets(spark, sf_dir):
    t = D.tiles(spark, sf_dir)
    return G.tile_offsets(t, 0.7).join(G.tile_offsets(t, 0.7, False).select("name", F.col("col_off").alias("col_round")), "name")


LAMBERT = f"""k AS (SELECT {A.CONE!r}::DOUBLE AS n, {A.RADIUS!r}::DOUBLE AS rad, {A.RHO0 + A.Y0!r}::DOUBLE AS top, {A.ECC!r}::DOUBLE AS e, {A.LAM0!r}::DOUBLE AS l0)"""


@query(f"""WITH {CELLS}, {LAMBERT}, p AS (SELECT r, c, 5 + c / 100.0::DOUBLE AS lon, 44 + r / 2000.0::DOUBLE AS lat FROM cells),
t AS (SELECT r, c, (radians(lon) - l0) * n AS th, rad * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))), e / 2), n) AS rho, top FROM p, k)
SELECT r AS "row", c AS "col", round(rho * sin(th) + 700000.0, 4) AS x, round(top - rho * cos(th), 4) AS y FROM t""")
def to_lambert93(spark, sf_dir):
    x, y = A.to_lambert93(5 + F.col("col") / 100.0, 44 + F.col("row") / 2000.0)
    return D.cells(spark, sf_dir).select("row", "col", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query(f'WITH {CELLS} SELECT {RC}, round(5 + c / 100.0::DOUBLE, 8) AS lon, round(44 + r / 2000.0::DOUBLE, 8) AS lat FROM cells')
def to_wgs84(spark, sf_dir):
    x, y = A.to_lambert93(5 + F.col("col") / 100.0, 44 + F.col("row") / 2000.0)
    there = D.cells(spark, sf_dir).select("row", "col", x.alias("x"), y.alias("y"))
    lon, lat = A.to_wgs84(F.col("x"), F.col("y"))
    return there.select("row", "col", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query(f'WITH {CELLS} SELECT {RC}, CASE WHEN nir + red <> 0 THEN (nir - red)::DOUBLE / (nir + red) END AS ndvi FROM cells')
def ndvi(spark, sf_dir):
    return D.cells(spark, sf_dir).select("row", "col", A.ndvi(F.col("nir"), F.col("red")).alias("ndvi"))


@query(f'WITH {CELLS} SELECT {RC}, CASE WHEN nir >= 100 THEN 1 WHEN nir IS NOT NULL THEN 0 END AS value FROM cells')
def binarize(spark, sf_dir):
    return D.cells(spark, sf_dir).select("row", "col", A.binarize(F.col("nir"), 100).alias("value"))


@query(f"WITH {PROB}, t AS (SELECT round(0.2 + i * 0.05, 2)::DOUBLE AS t FROM (SELECT unnest(range(0, 9)) AS i)) SELECT {RC}, 'terrasses_seuil_' || replace(format('{{:.2f}}', t), '.', '') AS label, CASE WHEN p1 >= t THEN 1 ELSE 0 END AS value FROM prob, t")
def threshold_sweep(spark, sf_dir):
    return A.threshold_sweep(D.probabilities(spark, sf_dir), "p1")


@query(f"WITH {PROB}, t AS (SELECT round(0.2 + i * 0.05, 2)::DOUBLE AS t FROM (SELECT unnest(range(0, 9)) AS i)) SELECT {RC}, CAST(sum(CASE WHEN p1 >= t THEN 1 ELSE 0 END) AS INT) AS level FROM prob, t GROUP BY r, c")
def threshold_level(spark, sf_dir):
    return D.probabilities(spark, sf_dir).select("row", "col", A.threshold_level(F.col("p1")).alias("level"))


@query(f'WITH {CELLS}, {LEGEND} SELECT cells.r AS "row", cells.c AS "col", coalesce(class_id, 0) AS class_id FROM cells LEFT JOIN legend ON cells.nir % 40 = value')
def reclass(spark, sf_dir):
    return A.reclass(D.cells(spark, sf_dir).withColumn("value", F.col("nir") % 40), "value", C.legend(_legend(spark, sf_dir))).select("row", "col", "class_id")


@query(f'WITH {CELLS}, s AS (SELECT min(nir) AS a, max(nir) AS b, min(red) AS d, max(red) AS e FROM cells) SELECT {RC}, (nir - a)::DOUBLE / (b - a) AS nir, (red - d)::DOUBLE / (e - d) AS red FROM cells, s')
def minmax_scale(spark, sf_dir):
    return A.minmax_scale(D.cells(spark, sf_dir).select("row", "col", "nir", "red"), ["nir", "red"])


@query(f'WITH {CELLS}, s AS (SELECT greatest(max(nir), max(red)) AS m FROM cells) SELECT {RC}, coalesce(nir, 0) / (m + 1e-8::DOUBLE) AS nir, coalesce(red, 0) / (m + 1e-8::DOUBLE) AS red FROM cells, s')
def max_scale(spark, sf_dir):
    return A.max_scale(D.cells(spark, sf_dir).select("row", "col", "nir", "red"), ["nir", "red"])


@query(f'WITH {CELLS} SELECT {RC}, CASE WHEN nir IS NULL AND red IS NULL THEN 255 WHEN nir >= red AND nir >= elev_cm % 200 THEN 0 WHEN red >= elev_cm % 200 THEN 1 ELSE 2 END AS cls FROM cells')
def argmax_class(spark, sf_dir):
    c = D.cells(spark, sf_dir).select("row", "col", "nir", "red", F.when(F.col("nir").isNotNull(), F.col("elev_cm") % 200).alias("third"))
    return c.select("row", "col", A.argmax_class(["nir", "red", "third"], 0, 255).alias("cls"))


@query(f'WITH {PROB} SELECT {RC}, greatest(p0, p1) AS p, CASE WHEN p0 >= p1 THEN 1 ELSE 2 END AS cls FROM prob')
def max_prob(spark, sf_dir):
    return D.probabilities(spark, sf_dir).select("row", "col", A.max_prob(["p0", "p1"]).alias("p"), A.argmax_class(["p0", "p1"]).alias("cls"))


@query(f'WITH {CELLS} SELECT {RC}, nullif(label, 0) AS label FROM cells')
def value_to_null(spark, sf_dir):
    return D.cells(spark, sf_dir).select("row", "col", A.value_to_null(F.col("label"), 0).alias("label"))


@query(f"""WITH {CELLS}, z AS (SELECT zone_id, avg(label) AS a, avg(nir) / 10 AS b, min(nir)::DOUBLE AS d FROM cells GROUP BY zone_id)
SELECT zone_id, CASE WHEN a >= 0.99 THEN 1 ELSE 0 END AS diag_convexite, CASE WHEN b IS NULL OR b < 7.5 THEN 1 ELSE 0 END AS diag_pente_moy, CASE WHEN d IS NULL OR d < 45 THEN 1 ELSE 0 END AS diag_pente_dec10 FROM z""")
def diagnostics(spark, sf_dir):
    z = D.cells(spark, sf_dir).groupBy("zone_id").agg(F.avg("label").alias("a"), (F.avg("nir") / 10).alias("b"), F.min("nir").cast("double").alias("d"))
    return z.select("zone_id", *A.diagnostics(F.col("a"), F.col("b"), F.col("d")))


@query(f"""WITH {CELLS} SELECT {RC}, '2_' || (r * 100 + c + 725) || '_i.tif' AS image, '2_' || (r * 100 + c + 725) || '_m.tif' AS mask, 'patch_proba_img' || (c % 3) || '_i' || r || '_j' || c || '.tif' AS win, (c % 20) || '_' || (c % 40) AS scenario FROM cells""")
def patch_name(spark, sf_dir):
    k = (F.col("row") * 100 + F.col("col")).cast("int")
    return D.cells(spark, sf_dir).select("row", "col", A.patch_name(k).alias("image"), A.patch_name(k, "m").alias("mask"), A.window_name(F.col("col") % 3, F.col("row"), F.col("col")).alias("win"), A.scenario_name(F.col("col") % 20, F.col("col") % 40).alias("scenario"))
