"""Queries of patches, polygons and landscape scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasol.functions import algebra as A
from terrasol.functions.geodesy import side_area_sql
from terrasol.operators import focal as N
from terrasol.operators import landscape as L
from terrasol.operators import patches as P
from terrasol.operators.topology import edges_of, following
from terrasol.plans import pipelines as W
from terrasol.plans.focal_queries import EDGE_SLOPE, SLOPE, box_sql, elevation
from terrasol.plans.register import query
from terrasol.sources import derived as D
from terrasol.sources.store import cut

CELLS = D.CELLS_SQL


def patches_sql(source: str, reach: int, by: str = "", name: str = "lab") -> str:
    """Runs, edges of adjacent rows and least-label search over the run graph (recursive), for cells of value 1."""
    g = f"{by}, " if by else ""
    on = f"AND a.{by} = b.{by}" if by else ""
    key = f"{by}, " if by else ""
    return f"""rn_{name} AS (SELECT {g}r, min(c) AS c0, max(c) AS c1, min(r * 100 + c) AS id FROM (SELECT {g}r, c, c - row_number() OVER (PARTITION BY {g}r ORDER BY c) AS k FROM {source}) GROUP BY {g}r, k),
ed_{name} AS (SELECT {'a.' + by + ',' if by else ''} a.id AS a, b.id AS b FROM rn_{name} a JOIN rn_{name} b ON b.r = a.r + 1 AND a.c0 <= b.c1 + {reach} AND b.c0 <= a.c1 + {reach} {on}),
e2_{name} AS (SELECT * FROM ed_{name} UNION ALL SELECT {key}b AS a, a AS b FROM ed_{name}),
rc_{name}({key}id, seen) AS (SELECT {key}id, id FROM rn_{name} UNION SELECT {'e.' + by + ',' if by else ''} e.b, s.seen FROM rc_{name} s JOIN e2_{name} e ON e.a = s.id {'AND e.' + by + ' = s.' + by if by else ''} WHERE e.b > s.seen),
{name} AS (SELECT {'n.' + by + ',' if by else ''} n.r, n.c0, n.c1, CAST(m.patch_id AS BIGINT) AS patch_id FROM rn_{name} n JOIN (SELECT {key}id, min(seen) AS patch_id FROM rc_{name} GROUP BY {key}id) m ON m.id = n.id {'AND m.' + by + ' = n.' + by if by else ''})"""


ONES = "ones AS (SELECT r, c FROM cells WHERE label = 1)"
LAB8, LAB4 = patches_sql("ones", 1), patches_sql("ones", 0)
BASE = f"WITH RECURSIVE {CELLS}, {ONES}"
CELL_ROWS = "pc AS (SELECT patch_id, r, CAST(unnest(range(c0, c1 + 1)) AS INT) AS c FROM lab)"


def _labelled(spark, sf_dir, neighbours=8):
    return P.label_runs(D.cells(spark, sf_dir), "label", D.WIDTH, neighbours)


@query(f'{BASE}, {LAB8}, {CELL_ROWS} SELECT patch_id, r AS "row", c AS "col" FROM pc')
def label_patches(spark, sf_dir):
    return P.run_cells(_labelled(spark, sf_dir))


@query(f'{BASE}, {LAB4}, {CELL_ROWS} SELECT patch_id, r AS "row", c AS "col" FROM pc')
def label_patches_4(spark, sf_dir):
    return P.run_cells(_labelled(spark, sf_dir, 4))


@query(f"{BASE}, tl AS (SELECT r // 4 AS tile, r, c FROM ones), {patches_sql('tl', 1, 'tile')} SELECT tile, patch_id, CAST(sum(c1 - c0 + 1) AS BIGINT) AS n FROM lab GROUP BY tile, patch_id")
def label_patches_by_tile(spark, sf_dir):
    """Patches cut at tile borders, all tiles in one labelling."""
    c = D.cells(spark, sf_dir).withColumn("tile", F.floor(F.col("row") / 4).cast("int"))
    return P.label_runs(c, "label", D.WIDTH, 8, ("tile",)).groupBy("tile", "patch_id").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))


@query(f"{BASE}, {LAB8} SELECT patch_id, CAST(sum(c1 - c0 + 1) AS DOUBLE) AS area FROM lab GROUP BY patch_id")
def patch_area(spark, sf_dir):
    return P.patch_area(_labelled(spark, sf_dir))


@query(f"{BASE}, {LAB4} SELECT patch_id, round(sum(c1 - c0 + 1) * 0.25::DOUBLE, 2) AS area FROM lab GROUP BY patch_id HAVING round(sum(c1 - c0 + 1) * 0.25::DOUBLE, 2) >= 2.5")
def min_area_filter(spark, sf_dir):
    return P.min_area_filter(P.patch_area(_labelled(spark, sf_dir, 4), 0.5, digits=2), 2.5)


PERIMETER = "CAST(sum(4 - (EXISTS (SELECT 1 FROM pc b WHERE b.patch_id = a.patch_id AND b.r = a.r - 1 AND b.c = a.c))::INT - (EXISTS (SELECT 1 FROM pc b WHERE b.patch_id = a.patch_id AND b.r = a.r + 1 AND b.c = a.c))::INT - (EXISTS (SELECT 1 FROM pc b WHERE b.patch_id = a.patch_id AND b.r = a.r AND b.c = a.c - 1))::INT - (EXISTS (SELECT 1 FROM pc b WHERE b.patch_id = a.patch_id AND b.r = a.r AND b.c = a.c + 1))::INT) AS DOUBLE)"


@query(f"{BASE}, {LAB8}, {CELL_ROWS} SELECT patch_id, {PERIMETER} AS perimeter FROM pc a GROUP BY patch_id")
def patch_perimeter(spark, sf_dir):
    return P.patch_perimeter(P.run_cells(_labelled(spark, sf_dir)))


@query(f"{BASE}, {LAB8}, {CELL_ROWS} SELECT a.patch_id, {PERIMETER} AS perimetre, CAST(count(*) AS DOUBLE) AS superficie FROM pc a GROUP BY a.patch_id")
def patch_outline(spark, sf_dir):
    """Outlines walked to rings give back each patch's area and perimeter."""
    rings = P.patch_outline(P.run_cells(_labelled(spark, sf_dir)))
    return P.ring_measures(rings).select("patch_id", "perimetre", "superficie")


# patches of gentle slope: hundreds, many of them not convex, some with holes
LOW = f"WITH RECURSIVE {SLOPE}, ones AS (SELECT r, c FROM slope WHERE slope <= 15)"


def _low(spark, sf_dir, neighbours):
    low = cut(N.slope(elevation(spark, sf_dir)).select("row", "col", (F.col("slope") <= 15).cast("int").alias("low")))
    return cut(P.label_runs(low, "low", D.WIDTH, neighbours))


@query(f"{LOW}, {LAB8}, {CELL_ROWS} SELECT a.patch_id, {PERIMETER} AS perimetre, CAST(count(*) AS DOUBLE) AS superficie FROM pc a GROUP BY a.patch_id")
def slope_outlines(spark, sf_dir):
    """Outlines of all patches of gentle slope, in blocks of 16 cells that most rings cross."""
    rings = P.patch_outline(P.run_cells(_low(spark, sf_dir, 8)), size=16)
    return P.ring_measures(rings).select("patch_id", "perimetre", "superficie")


@query(f"{LOW}, {LAB4}, {CELL_ROWS} SELECT patch_id, r AS \"row\", c AS \"col\" FROM pc")
def burn_patches(spark, sf_dir):
    """Outlines of patches, holes and all, burnt back to cells."""
    return P.rasterize_rings(P.patch_outline(P.run_cells(_low(spark, sf_dir, 4))))


# a hull's side has all points on its right or between its ends
@query(f"""{LOW}, {LAB8}, rw AS (SELECT patch_id, r, min(c0) AS c0, max(c1) + 1 AS c1, sum(c1 - c0 + 1) AS n FROM lab GROUP BY patch_id, r),
pt AS (SELECT DISTINCT patch_id, unnest([c0, c1, c0, c1])::BIGINT AS x, unnest([r, r, r + 1, r + 1])::BIGINT AS y FROM rw),
hs AS (SELECT a.patch_id, a.x * b.y - b.x * a.y AS w FROM pt a JOIN pt b ON a.patch_id = b.patch_id AND (a.x <> b.x OR a.y <> b.y)
 WHERE NOT EXISTS (SELECT 1 FROM pt s WHERE s.patch_id = a.patch_id AND ((b.x - a.x) * (s.y - a.y) - (b.y - a.y) * (s.x - a.x) > 0
  OR ((b.x - a.x) * (s.y - a.y) = (b.y - a.y) * (s.x - a.x) AND (s.x - a.x) * (s.x - b.x) + (s.y - a.y) * (s.y - b.y) > 0)))),
ha AS (SELECT patch_id, abs(sum(w)) / 2.0::DOUBLE AS hull FROM hs GROUP BY patch_id)
SELECT patch_id, round(n / hull, 9) AS convexity FROM ha JOIN (SELECT patch_id, sum(n)::DOUBLE AS n FROM rw GROUP BY patch_id) USING (patch_id)""")
def patch_convexity(spark, sf_dir):
    return P.patch_convexity(_low(spark, sf_dir, 8), band=4).withColumn("convexity", F.round("convexity", 9))


@query()
def simplify_rings(spark, sf_dir):
    rings = cut(P.simplify_rings(P.patch_outline(P.run_cells(_low(spark, sf_dir, 4)))))
    return P.ring_measures(rings).join(rings.groupBy("patch_id").agg(F.count("*").alias("points")), "patch_id")


# zones tile the grid: junctions (other than two sides) stay, and four in ten of the other corners
@query(f"""WITH {CELLS}, n AS (SELECT r, c, zone_id AS z FROM cells),
e AS (SELECT DISTINCT * FROM (
 SELECT a.c AS x, a.r AS y, a.c + 1 AS x2, a.r AS y2 FROM n a LEFT JOIN n b ON b.r = a.r - 1 AND b.c = a.c WHERE b.z IS DISTINCT FROM a.z
 UNION ALL SELECT a.c, a.r + 1, a.c + 1, a.r + 1 FROM n a LEFT JOIN n b ON b.r = a.r + 1 AND b.c = a.c WHERE b.z IS DISTINCT FROM a.z
 UNION ALL SELECT a.c, a.r, a.c, a.r + 1 FROM n a LEFT JOIN n b ON b.r = a.r AND b.c = a.c - 1 WHERE b.z IS DISTINCT FROM a.z
 UNION ALL SELECT a.c + 1, a.r, a.c + 1, a.r + 1 FROM n a LEFT JOIN n b ON b.r = a.r AND b.c = a.c + 1 WHERE b.z IS DISTINCT FROM a.z)),
v AS (SELECT x, y, count(*) AS d FROM (SELECT x, y FROM e UNION ALL SELECT x2, y2 FROM e) GROUP BY x, y)
SELECT (SELECT count(DISTINCT z) FROM n) AS zones, count(*) AS corners, count(*) FILTER (WHERE d <> 2) AS junctions, CAST(count(*) - floor(count(*) FILTER (WHERE d = 2) * 0.6::DOUBLE) AS BIGINT) AS kept, CAST(0 AS BIGINT) AS gaps FROM v""")
def simplify_zones(spark, sf_dir):
    """Borders of all zones simplified together: corners before and after, and sides inside the grid's frame that only one zone has."""
    cells = D.cells(spark, sf_dir).select(F.col("zone_id").alias("patch_id"), "row", "col")
    points = cut(P.patch_outline(cells, every=True))
    kept = cut(P.simplify_rings(points))
    sides = following(kept, ["patch_id", "ring"])
    here, there = F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    count = sides.groupBy(F.least(here, there).alias("a"), F.greatest(here, there).alias("b")).agg(F.count("*").alias("n"))
    # sides of one zone only make the outer ring: where it is closed, every corner of it has two of them
    alone = count.where("n = 1").select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    before = edges_of(points).select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    return (
        before.agg(F.count("*").alias("corners"), F.count_if(F.col("d") != 2).alias("junctions"))
        .crossJoin(F.broadcast(kept.agg(F.countDistinct("patch_id").alias("zones"))))
        .crossJoin(F.broadcast(kept.select("x", "y").distinct().agg(F.count("*").alias("kept"))))
        .crossJoin(F.broadcast(count.where("n > 2").agg(F.count("*").alias("over")).crossJoin(alone.agg(F.count_if(F.col("d") != 2).alias("open")))))
        .select("zones", "corners", "junctions", "kept", (F.col("over") + F.col("open")).alias("gaps"))
    )


BOXRING = "bx AS (SELECT zone_id AS patch_id, min(c)::DOUBLE AS x0, max(c) + 1.0::DOUBLE AS x1, (0 - min(r))::DOUBLE AS y1, 0 - (max(r) + 1.0::DOUBLE) AS y0 FROM cells GROUP BY zone_id)"


def _zone_rings(spark, sf_dir):
    z = D.cells(spark, sf_dir).groupBy(F.col("zone_id").alias("patch_id")).agg(F.min("col").cast("double").alias("x0"), (F.max("col") + 1.0).alias("x1"), (-F.min("row")).cast("double").alias("y1"), (-(F.max("row") + 1.0)).alias("y0"))
    corner = lambda k, x, y: F.struct(F.lit(k).alias("idx"), F.col(x).alias("x"), F.col(y).alias("y"))
    return z.select("patch_id", F.lit(0).alias("ring"), F.inline(F.array(corner(0, "x0", "y1"), corner(1, "x1", "y1"), corner(2, "x1", "y0"), corner(3, "x0", "y0"))))


@query(f"""WITH {CELLS}, {BOXRING}, p AS (SELECT patch_id, unnest([0, 1, 2, 3]) AS idx, unnest([x0, x1, x1, x0]) AS x, unnest([y1, y1, y0, y0]) AS y FROM bx),
n AS (SELECT a.patch_id, a.idx, a.x, a.y, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON a.patch_id = b.patch_id AND b.idx = (a.idx + 1) % 4)
SELECT patch_id, 0 AS ring, CAST(idx * 2 + k AS INT) AS idx, x * (1 - t) + x2 * t AS x, y * (1 - t) + y2 * t AS y FROM n, (SELECT unnest([0, 1]) AS k, unnest([0.25::DOUBLE, 0.75::DOUBLE]) AS t)""")
def chaikin_rings(spark, sf_dir):
    return P.chaikin_rings(_zone_rings(spark, sf_dir))


@query(f"""WITH {CELLS}, {BOXRING}, p AS (SELECT patch_id, unnest([0, 1, 2, 3]) AS idx, 5 + unnest([x0, x1, x1, x0]) / 100 AS x, 44 + unnest([y1, y1, y0, y0]) / 2000 AS y FROM bx)
SELECT a.patch_id, round(abs(sum({side_area_sql("a.x", "a.y", "b.x", "b.y")})), 3) AS area FROM p a JOIN p b ON a.patch_id = b.patch_id AND b.idx = (a.idx + 1) % 4 GROUP BY a.patch_id""")
def ellipsoid_area(spark, sf_dir):
    """Areas of the zones, laid out in degrees, on the ellipsoid."""
    rings = _zone_rings(spark, sf_dir).withColumns({"x": 5 + F.col("x") / 100, "y": 44 + F.col("y") / 2000})
    return P.ellipsoid_area(rings).withColumn("area", F.round("area", 3))


@query(f'WITH {CELLS} SELECT r AS "row", c AS "col", zone_id AS patch_id FROM cells')
def rasterize_patches(spark, sf_dir):
    """Zone boxes burnt back to cells give the zones."""
    return P.rasterize_patches(P.rings_of(_zone_rings(spark, sf_dir)))


STEEP = "steep AS (SELECT r, c FROM cells WHERE nir >= 200)"


@query(f"""{BASE}, {LAB4}, {CELL_ROWS}, {STEEP} SELECT DISTINCT p.patch_id FROM pc p JOIN steep s ON s.r BETWEEN p.r - 3 AND p.r + 3 AND s.c BETWEEN p.c - 3 AND p.c + 3
WHERE greatest(abs(s.r - p.r) - 1, 0) ** 2 + greatest(abs(s.c - p.c) - 1, 0) ** 2 <= 4""")
def near_patches(spark, sf_dir):
    c = cut(D.cells(spark, sf_dir))
    return P.near_patches(P.label_patches(c, "label", D.WIDTH, 4), c.where("nir >= 200").select("row", "col"), 2.0)


@query(f"WITH {CELLS}, p AS (SELECT zone_id AS patch_id, avg(label) AS dens_mean FROM cells GROUP BY 1) SELECT patch_id, dens_mean FROM p WHERE dens_mean BETWEEN 0.3 AND 0.6")
def density_select(spark, sf_dir):
    return P.density_select(D.cells(spark, sf_dir).groupBy(F.col("zone_id").alias("patch_id")).agg(F.avg("label").alias("dens_mean")))


def _flagged(spark, sf_dir):
    return D.cells(spark, sf_dir).groupBy(F.col("zone_id").alias("patch_id")).agg(F.sum("nir").cast("double").alias("superficie"), F.max(F.when(F.col("red") > 40, 1).otherwise(0)).alias("diag_a"), F.min("label").alias("diag_b"))


FLAGGED = "p AS (SELECT zone_id AS patch_id, CAST(sum(nir) AS DOUBLE) AS superficie, max(CASE WHEN red > 40 THEN 1 ELSE 0 END) AS diag_a, min(label) AS diag_b FROM cells GROUP BY 1)"


@query(f"WITH {CELLS}, {FLAGGED} SELECT * FROM p WHERE (diag_a = 1 OR diag_b = 1) AND superficie <= 1600")
def diagnostic_select(spark, sf_dir):
    return P.diagnostic_select(_flagged(spark, sf_dir), 1600.0)


@query(f"WITH {CELLS}, {FLAGGED} SELECT patch_id, superficie FROM p UNION ALL SELECT patch_id, superficie FROM p WHERE superficie > 500")
def union_layers(spark, sf_dir):
    f = _flagged(spark, sf_dir).select("patch_id", "superficie")
    return P.union_layers([f, f.where("superficie > 500")])


@query(f"WITH {CELLS}, {FLAGGED} SELECT * FROM p WHERE (diag_a = 1 OR diag_b = 1) AND superficie <= 1600")
def fused_layers(spark, sf_dir):
    """Three layers of patches, each filtered, as one."""
    f = _flagged(spark, sf_dir)
    return W.fused_layers([f.where(F.pmod("patch_id", F.lit(3)) == k) for k in range(3)], 1600.0)


SCENARIOS = L.sensitivity_grid(buffers=(1,))
GRID = "sc AS (SELECT low || '_' || steep AS scenario_id, low, steep FROM (SELECT unnest([10, 15, 20]) AS low), (SELECT unnest([25, 30, 35]) AS steep) WHERE low < steep)"


@query("SELECT low || '_' || steep || '_' || buffer AS scenario_id, CAST(low AS DOUBLE) AS low_max, CAST(steep AS DOUBLE) AS steep_min, CAST(buffer AS DOUBLE) AS buffer, n FROM (SELECT unnest([10, 20, 30]) AS low), (SELECT unnest([25, 30]) AS steep), (SELECT unnest([5, 10]) AS buffer), (SELECT count(*) AS n FROM orders) WHERE low < steep")
def sensitivity_grid(spark, sf_dir):
    """Scenario rows beside the number of cells they will be run on."""
    rows = spark.createDataFrame(L.sensitivity_grid((10, 20, 30), (25, 30), (5, 10)), "scenario_id string, low_max double, steep_min double, buffer double")
    return rows.crossJoin(F.broadcast(spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.count("*").alias("n"))))


SELECTED = f"""WITH RECURSIVE {EDGE_SLOPE}, {GRID}, lowm AS (SELECT low, r, c FROM eslope, (SELECT DISTINCT low FROM sc) WHERE slope <= low), {patches_sql('lowm', 0, 'low')},
big AS (SELECT low, patch_id FROM lab GROUP BY 1, 2 HAVING sum(c1 - c0 + 1) >= 5), pc AS (SELECT low, patch_id, r, CAST(unnest(range(c0, c1 + 1)) AS INT) AS c FROM lab JOIN big USING (low, patch_id)),
st AS (SELECT steep, r, c, CASE WHEN slope >= steep THEN 1 ELSE 0 END AS s FROM eslope, (SELECT DISTINCT steep FROM sc)),
d1 AS (SELECT a.steep, a.r, a.c, sum(b.s) AS s, count(*) AS n FROM st a JOIN st b ON a.steep = b.steep AND a.r = b.r AND b.c BETWEEN a.c - 4 AND a.c + 4 GROUP BY 1, 2, 3),
dens AS (SELECT a.steep, a.r, a.c, sum(b.s)::DOUBLE / sum(b.n) AS d FROM d1 a JOIN d1 b ON a.steep = b.steep AND a.c = b.c AND b.r BETWEEN a.r - 4 AND a.r + 4 GROUP BY 1, 2, 3),
near AS (SELECT DISTINCT sc.scenario_id, sc.low, sc.steep, p.patch_id FROM sc JOIN pc p USING (low) JOIN st s ON s.steep = sc.steep AND s.s = 1 AND s.r BETWEEN p.r - 2 AND p.r + 2 AND s.c BETWEEN p.c - 2 AND p.c + 2 AND greatest(abs(s.r - p.r) - 1, 0) ** 2 + greatest(abs(s.c - p.c) - 1, 0) ** 2 <= 1),
kept AS (SELECT near.scenario_id, near.low, patch_id FROM near JOIN pc USING (low, patch_id) JOIN dens ON dens.steep = near.steep AND dens.r = pc.r AND dens.c = pc.c GROUP BY 1, 2, 3 HAVING avg(d) BETWEEN 0.36 AND 0.6),
sel AS (SELECT scenario_id, patch_id, r, c FROM kept JOIN pc USING (low, patch_id))"""


def _selected(spark, sf_dir):
    slopes = cut(N.slope_with_edges(elevation(spark, sf_dir)))
    return L.scenario_areas(slopes, SCENARIOS, D.WIDTH, 5.0, (0.36, 0.6), 4)


@query(f"{SELECTED} SELECT scenario_id, patch_id, CAST(count(*) AS BIGINT) AS n FROM sel GROUP BY 1, 2")
def landscape_scenarios(spark, sf_dir):
    return _selected(spark, sf_dir).groupBy("scenario_id", "patch_id").agg(F.count("*").alias("n"))


@query(f"{SELECTED} SELECT patch_id, CAST(count(*) AS DOUBLE) AS area FROM sel WHERE scenario_id = '15_25' GROUP BY 1")
def landscape_scenario(spark, sf_dir):
    return L.landscape_scenario(elevation(spark, sf_dir), "elev", D.WIDTH, 15, 25, 1, density=(0.36, 0.6), half=4)


PAIRS = "pr AS (SELECT a.scenario_id AS a, b.scenario_id AS b FROM sc a JOIN sc b ON a.low * 100 + a.steep < b.low * 100 + b.steep AND (a.low <> b.low) <> (a.steep <> b.steep))"


@query(f"""{SELECTED}, {PAIRS}, ar AS (SELECT scenario_id, count(*) AS n FROM sel GROUP BY 1), it AS (SELECT x.scenario_id AS a, y.scenario_id AS b, count(*) AS n FROM sel x JOIN sel y ON x.r = y.r AND x.c = y.c GROUP BY 1, 2),
j AS (SELECT pr.a, pr.b, coalesce(it.n, 0) AS i, coalesce(p.n, 0) + coalesce(q.n, 0) - coalesce(it.n, 0) AS u FROM pr LEFT JOIN it ON it.a = pr.a AND it.b = pr.b LEFT JOIN ar p ON p.scenario_id = pr.a LEFT JOIN ar q ON q.scenario_id = pr.b)
SELECT a, b, CAST(i AS DOUBLE) AS inter, CAST(u AS DOUBLE) AS "union", CASE WHEN u > 0 THEN round(i::DOUBLE / u, 3) ELSE 0 END AS jaccard FROM j""")
def jaccard_pairs(spark, sf_dir):
    return L.jaccard_pairs(_selected(spark, sf_dir), SCENARIOS)


@query(f"""WITH RECURSIVE {D.TERRACE_SQL}, o AS (SELECT r, c, CAST(p >= 250 AS INT) AS one FROM terr), {box_sql('o', 'one', 2)}, ones AS (SELECT r, c FROM box WHERE 2 * s > n),
{LAB8} SELECT patch_id, CAST(sum(c1 - c0 + 1) AS DOUBLE) AS area FROM lab GROUP BY patch_id HAVING sum(c1 - c0 + 1) >= 10""")
def terrace_areas(spark, sf_dir):
    """The forest workflow up to the areas: threshold, majority, patches of ten square metres or more."""
    one = D.terrace_probabilities(spark, sf_dir).select("row", "col", A.binarize(F.col("p1"), 0.25).alias("one"))
    return P.min_area_filter(P.patch_area(P.label_runs(N.majority_filter(one, "one"), "mode", D.WIDTH)))


def terrace_cells(spark, sf_dir):
    """Elevations beside the probabilities: both grow with the input, so none is sent to all tasks by way of the driver."""
    return elevation(spark, sf_dir).join(D.terrace_probabilities(spark, sf_dir).hint("merge"), ["row", "col"])


@query()
def terrace_map(spark, sf_dir):
    """The forest workflow from probabilities to selected patches."""
    return W.terrace_patches(terrace_cells(spark, sf_dir), D.WIDTH)
