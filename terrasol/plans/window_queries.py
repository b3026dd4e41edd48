"""Queries of learning windows, weighted merges and the forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasol.operators import focal as N
from terrasol.operators import forest as T
from terrasol.operators import ranks as R
from terrasol.operators import windows as V
from terrasol.plans import pipelines as W
from terrasol.plans.focal_queries import SLOPE, elevation
from terrasol.plans.register import query
from terrasol.sources import derived as D
from terrasol.sources.store import cut, new_path

CELLS, PROB = D.CELLS_SQL, D.PROB_SQL
P, S = 8, 4
BANDS = f"{CELLS}, bands AS (SELECT r, c, nir, red, CASE WHEN red >= 45 THEN 2 WHEN red IS NOT NULL THEN 1 ELSE 0 END AS cls FROM cells)"
GOOD = f"{BANDS}, good AS (SELECT r // 8 AS wr, c // 8 AS wc FROM bands GROUP BY 1, 2 HAVING count(*) = 64 AND bool_or(cls = 2) AND count(nir) = 64 AND count(red) = 64)"


def _bands(spark, sf_dir):
    cls = F.when(F.col("red") >= 45, 2).when(F.col("red").isNotNull(), 1).otherwise(0)
    return D.cells(spark, sf_dir).select("row", "col", "nir", "red", cls.alias("cls"))


@query(f"WITH {GOOD} SELECT CAST(wr AS INT) AS wr, CAST(wc AS INT) AS wc FROM good")
def grid_patches(spark, sf_dir):
    return V.grid_patches(_bands(spark, sf_dir), ["nir", "red"], patch=P)


@query(f"WITH {GOOD} SELECT CAST(wr AS INT) AS wr, CAST(wc AS INT) AS wc, CAST(row_number() OVER (ORDER BY wr, wc) + 725 AS INT) AS number FROM good")
def number_patches(spark, sf_dir):
    return V.number_patches(V.grid_patches(_bands(spark, sf_dir), ["nir", "red"], patch=P))


@query(f"WITH {GOOD} SELECT CAST(wr AS INT) AS wr, CAST(wc AS INT) AS wc, string_agg(CAST(nir AS VARCHAR), ',' ORDER BY r, c) AS nir, string_agg(CAST(red AS VARCHAR), ',' ORDER BY r, c) AS red FROM bands JOIN good ON r // 8 = wr AND c // 8 = wc GROUP BY 1, 2")
def pack_windows(spark, sf_dir):
    b = cut(_bands(spark, sf_dir))
    good = V.grid_patches(b, ["nir", "red"], patch=P)
    cells = b.withColumn("wr", F.floor(F.col("row") / P).cast("int")).withColumn("wc", F.floor(F.col("col") / P).cast("int")).join(good, ["wr", "wc"])
    packed = V.pack_windows(cells, ["wr", "wc"], ["nir", "red"], (F.col("row") % P) * P + F.col("col") % P)
    return packed.select("wr", "wc", *(F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c) for c in ("nir", "red")))


@query()
def negative_patches(spark, sf_dir):
    return V.negative_patches(cut(_bands(spark, sf_dir)), ["nir", "red"], patch=4, count=50, tries=5000)


COVER = f"""{BANDS}, sz AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM bands), wi AS (SELECT unnest(range(0, CAST(h - 8 + 1 AS BIGINT), 4)) AS i FROM sz), wj AS (SELECT unnest(range(0, CAST(w - 8 + 1 AS BIGINT), 4)) AS j FROM sz),
ow AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, r, c, nir, red FROM wi, wj JOIN bands ON r >= i AND r < i + 8 AND c >= j AND c < j + 8)"""


@query(f'WITH {COVER} SELECT i, j, r AS "row", c AS "col", nir FROM ow')
def overlap_windows(spark, sf_dir):
    return V.overlap_windows(_bands(spark, sf_dir), P, S).select("i", "j", "row", "col", "nir")


@query(f"WITH {COVER} SELECT i, j, CASE WHEN count(nir) < 64 OR count(red) < 64 THEN 'nodata' WHEN NOT bool_or(nir <> 0 OR red <> 0) THEN 'zero' WHEN NOT bool_or(red <> 0) THEN 'key_zero' ELSE 'ok' END AS reason FROM ow GROUP BY i, j")
def window_validity(spark, sf_dir):
    return V.window_validity(V.overlap_windows(_bands(spark, sf_dir), P, S), ["nir", "red"], "red")


def toy_model():
    """A stand-in for a user's model: shares of two classes from the bands."""

    def model(bands):
        out = []
        for n, r in zip(bands["nir"], bands["red"]):
            p = r / (n + r) if n + r else 0.0
            out += [1 - p, p]
        return out

    return model


@query()
def score_windows(spark, sf_dir):
    w = cut(V.overlap_windows(_bands(spark, sf_dir), P, S))
    ok = V.window_validity(w, ["nir", "red"], "red").where("reason = 'ok'").select("i", "j")
    packed = V.pack_windows(w.join(ok, ["i", "j"]), ["i", "j"], ["nir", "red"], (F.col("row") - F.col("i")) * P + F.col("col") - F.col("j"))
    scores = V.score_windows(packed, ["nir", "red"], 2, toy_model, P)
    return V.hann_merge(V.scored_cells(scores, P, 2), ["p0", "p1"], P)


@query(f"""WITH {COVER}, ok AS (SELECT i, j FROM ow GROUP BY i, j HAVING count(nir) = 64 AND count(red) = 64 AND bool_or(red <> 0)),
m AS (SELECT r, c, sum((0.5 - 0.5 * cos((r - i) * (2 * pi() / 7))) * (0.5 - 0.5 * cos((c - j) * (2 * pi() / 7)))) AS w, coalesce(any_value(red::DOUBLE / nullif(nir + red, 0)), 0) AS p FROM ow JOIN ok USING (i, j) GROUP BY r, c)
SELECT r AS "row", c AS "col", CASE WHEN w <= 1e-12 THEN 0 WHEN p > 0.5 THEN 2 ELSE 1 END AS cls, CASE WHEN w > 1e-12 THEN round(greatest(p, 1 - p) + 1e-6, 4) END AS p FROM m""")
def window_map(spark, sf_dir):
    """Windows to a class map with the stand-in model, which gives a cell the same shares in every window.  Models answer
    in single precision, so a share halfway between two decimals is lifted over it before it is rounded, here and in the SQL."""
    return W.window_map(_bands(spark, sf_dir), ["nir", "red"], "red", toy_model, 2, P, S).withColumn("p", F.round(F.col("p") + 1e-6, 4))


WP = f"""{COVER}, {PROB}, wp AS (SELECT ow.i, ow.j, ow.r, ow.c, p1 * ((ow.i // 4) % 3 + 1) / 3 AS a, p0 * ((ow.j // 4) % 2 + 1) / 2 AS b,
(0.5 - 0.5 * cos((ow.r - ow.i) * (2 * pi() / 7))) * (0.5 - 0.5 * cos((ow.c - ow.j) * (2 * pi() / 7))) AS w FROM ow JOIN prob ON ow.r = prob.r AND ow.c = prob.c)"""


def _windowed(spark, sf_dir):
    w = V.overlap_windows(D.probabilities(spark, sf_dir), P, S)
    return w.select("i", "j", "row", "col", (F.col("p1") * (F.floor(F.col("i") / 4) % 3 + 1) / 3).alias("a"), (F.col("p0") * (F.floor(F.col("j") / 4) % 2 + 1) / 2).alias("b"))


@query(f'WITH {WP} SELECT r AS "row", c AS "col", CASE WHEN sum(w) > 1e-12 THEN round(sum(w * a) / sum(w), 6) END AS a, CASE WHEN sum(w) > 1e-12 THEN round(sum(w * b) / sum(w), 6) END AS b FROM wp GROUP BY r, c')
def hann_merge(spark, sf_dir):
    return V.hann_merge(_windowed(spark, sf_dir), ["a", "b"], P).withColumns({c: F.round(c, 6) for c in ("a", "b")})


@query(f'WITH {WP} SELECT r AS "row", c AS "col", CASE WHEN sum(w) > 1e-12 THEN round(sum(w * greatest(a, b)) / sum(w), 6) ELSE 0 END AS p FROM wp GROUP BY r, c')
def max_prob_mosaic(spark, sf_dir):
    return V.max_prob_mosaic(_windowed(spark, sf_dir), ["a", "b"], P).withColumn("p", F.round("p", 6))


# three strips of 40 columns from 0, 30 and 60, border 6
@query(f"""WITH {CELLS}, st AS (SELECT o, r, c, (nir + o) % 7 AS v, c - o AS k FROM cells, (SELECT unnest([0, 30, 60]) AS o) WHERE c >= o AND c < o + 40),
w AS (SELECT r, c, v, CASE WHEN k < 6 THEN 0.5 - 0.5 * cos(k * (2 * pi() / 11)) WHEN k >= 34 THEN 0.5 - 0.5 * cos((39 - k) * (2 * pi() / 11)) ELSE 1 END AS w FROM st)
SELECT r AS "row", c AS "col", CAST(CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w END) > 1e-12 THEN floor(round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 9)) ELSE 0 END AS INT) AS v FROM w GROUP BY r, c""")
def edge_taper_merge(spark, sf_dir):
    c = D.cells(spark, sf_dir).select("row", "col", "nir", F.explode(F.array(*map(F.lit, (0, 30, 60)))).alias("offset"))
    s = c.where((F.col("col") >= F.col("offset")) & (F.col("col") < F.col("offset") + 40)).select("row", "col", "offset", F.lit(40).alias("wide"), ((F.col("nir") + F.col("offset")) % 7).alias("v"))
    return V.edge_taper_merge(s, "v", 6)


FEATURES = ["pente", "ndvi", "sd_r3", "tri_r3"]


def _features(spark, sf_dir):
    c = cut(elevation(spark, sf_dir).select("row", "col", "elev", "nir", "red", "label"))
    return N.terrain_features(c, radii=(3,), size=64).join(c.select("row", "col", "label"), ["row", "col"])


@query(f"WITH {SLOPE} SELECT round(slope, 6) AS pente, round((nir - red)::DOUBLE / nullif(nir + red, 0), 6) AS ndvi, label FROM slope JOIN cells USING (r, c) WHERE slope IS NOT NULL AND nir + red <> 0 AND label IS NOT NULL")
def training_table(spark, sf_dir):
    f = _features(spark, sf_dir).select("row", "col", *(F.round(c, 6).alias(c) for c in ("pente", "ndvi")), "label")
    return T.training_table(f)


@query(f"WITH {CELLS} SELECT label, 1.0::DOUBLE / count(*) AS weight, count(*) AS n FROM cells WHERE label IS NOT NULL GROUP BY label")
def class_weights(spark, sf_dir):
    return T.class_weights(D.cells(spark, sf_dir).select("nir", "label").na.drop()).groupBy("label").agg(F.first("weight").alias("weight"), F.count("*").alias("n"))


@query(f'WITH {CELLS} SELECT r AS "row", c AS "col", red, nir, elev_cm FROM cells')
def align_features(spark, sf_dir):
    return T.align_features(D.cells(spark, sf_dir).select("elev_cm", "row", "nir", "col", "red"), ["red", "nir", "elev_cm"])


def _split(spark, sf_dir):
    f = cut(_features(spark, sf_dir))
    place = F.col("row") * D.WIDTH + F.col("col")
    return f, f.where(~T.held_out(place)), f.where(T.held_out(place))


@query()
def predict_cells(spark, sf_dir):
    f, train, _ = _split(spark, sf_dir)
    return T.predict_cells(T.train_forest(T.training_table(train), FEATURES, trees=10, depth=6), f)


@query()
def forest_error(spark, sf_dir):
    """The error of a forest that was saved and loaded."""
    _, train, held = _split(spark, sf_dir)
    path = new_path(spark)
    T.save_model(T.train_forest(T.training_table(train), FEATURES, trees=10, depth=6), path)
    return T.forest_error(T.load_model(path), held.select(*FEATURES, "label"))


@query()
def permutation_importance(spark, sf_dir):
    _, train, held = _split(spark, sf_dir)
    keyed = held.withColumn("key", F.col("row") * D.WIDTH + F.col("col"))
    return T.permutation_importance(T.train_forest(T.training_table(train), FEATURES, trees=10, depth=6), keyed, key="key")


@query(f"""WITH {CELLS}, p AS (SELECT r, c, nir, row_number() OVER (ORDER BY r * 100 + c) AS i, row_number() OVER (ORDER BY md5('7:' || (r * 100 + c))) AS j FROM cells)
SELECT a.r AS "row", a.c AS "col", a.nir, b.nir AS other FROM p a JOIN p b ON a.i = b.j""")
def permuted_band(spark, sf_dir):
    """Every cell beside the value of its partner in a random permutation of all cells."""
    c = D.cells(spark, sf_dir).select("row", "col", "nir", (F.col("row") * D.WIDTH + F.col("col")).alias("key"))
    return R.permuted(c, ["nir"], "key", 7).select("row", "col", "nir", F.col("_p_nir").alias("other"))


# one yes-or-no feature: a tree of depth 1 gives each side its share of the bag, or both the bag's if they answer alike
VOTES = f"""{CELLS}, rw AS (SELECT r * 100 + c AS key, label, CAST(red >= 40 AS INT) AS x FROM cells WHERE label IS NOT NULL AND red IS NOT NULL),
cl AS (SELECT label, (SELECT count(*) FROM rw) / (2.0::DOUBLE * count(*)) AS rate FROM rw GROUP BY label),
cd AS (SELECT label, j, floor(4294967296 * least(1, sum(exp(j * ln(rate) - rate - lgamma(j + 1.0))) OVER (PARTITION BY label ORDER BY j))) AS bound FROM cl, range(60) t(j)),
us AS (SELECT rw.*, t, ('0x' || substr(md5('42:' || t || ':' || key), 1, 8))::BIGINT AS u FROM rw, range(30) q(t)),
bg AS (SELECT us.key, us.t, any_value(us.label) AS label, any_value(x) AS x, count(*) FILTER (WHERE u >= bound) AS times FROM us JOIN cd ON cd.label = us.label GROUP BY us.key, us.t),
sd AS (SELECT t, x, sum(times * label)::DOUBLE / sum(times) AS p, sum(times * label) AS y, sum(times) AS n FROM bg GROUP BY t, x HAVING sum(times) > 0),
tr AS (SELECT t, sum(y)::DOUBLE / sum(n) AS p, bool_or(p > 0.5) <> bool_and(p > 0.5) AS parted FROM sd GROUP BY t),
vt AS (SELECT bg.key, any_value(bg.label) AS label, count(*) AS votes, avg(CASE WHEN parted THEN sd.p ELSE tr.p END) AS p FROM bg JOIN sd ON sd.t = bg.t AND sd.x = bg.x JOIN tr ON tr.t = bg.t WHERE times = 0 GROUP BY bg.key)"""


@query(f"WITH {VOTES} SELECT round(avg((p - label) ** 2), 6) AS brier, round(avg(CAST((p > 0.5) = (label = 1) AS INT)), 6) AS accuracy, count(*) AS n, CAST(sum(votes) AS BIGINT) AS votes FROM vt")
def oob_error(spark, sf_dir):
    """Thirty trees of one split: SQL recounts their bags, their shares and the votes of the trees that did not see a cell."""
    c = D.cells(spark, sf_dir).select((F.col("row") * D.WIDTH + F.col("col")).alias("key"), "label", (F.col("red") >= 40).cast("int").alias("x"))
    c = cut(c.na.drop())
    return T.oob_error(T.oob_votes(T.train_bagged(c, ["x"], depth=1), c)).withColumns({m: F.round(m, 6) for m in ("brier", "accuracy")})


def _forest(spark, sf_dir):
    """All features of the default radii, with each cell's number, and a forest of the default size on them."""
    c = cut(elevation(spark, sf_dir).select("row", "col", "elev", "nir", "red", "label"))
    f = N.terrain_features(c).join(c.select("row", "col", "label"), ["row", "col"])
    f = cut(f.withColumn("key", F.col("row") * D.WIDTH + F.col("col")).drop("row", "col"))
    return f, T.train_bagged(f, [n for n in f.columns if n not in ("key", "label")])


@query()
def forest_oob(spark, sf_dir):
    f, forest = _forest(spark, sf_dir)
    return T.oob_error(T.oob_votes(forest, f))


@query()
def forest_importance(spark, sf_dir):
    f, forest = _forest(spark, sf_dir)
    return T.oob_importance(forest, f)


@query(f"""WITH {SLOPE}, f AS (SELECT slope, (nir - red)::DOUBLE / nullif(nir + red, 0) AS ndvi, label FROM slope JOIN cells USING (r, c))
SELECT 30 AS n_trees, (SELECT count(*) FROM f WHERE slope IS NOT NULL AND ndvi IS NOT NULL AND label IS NOT NULL) AS n_rows, count(*) AS n_predicted, count(*) AS n_same, count(*) AS n_whole
FROM f WHERE slope IS NOT NULL AND ndvi IS NOT NULL""")
def train_forest(spark, sf_dir):
    """A forest on slope and vegetation: its trees, the rows it learnt from, the cells with an answer, and of these the
    ones whose answer is the same after saving and loading, and whose class probabilities add up to one."""
    cells = _features(spark, sf_dir).select("row", "col", "pente", "ndvi", "label")
    cells = cut(cells)
    table = T.training_table(cells)
    model = T.train_forest(table, ["pente", "ndvi"])
    path = new_path(spark)
    T.save_model(model, path)
    again = T.load_model(path)
    # the second answer beside the first, in one pass: cells need not meet in a join
    first = T.predict_cells(model, cells, ("pente", "ndvi")).withColumnsRenamed({"p0": "first_p0", "p1": "first_p1"})
    both = T.predict_cells(again, first, ("first_p0", "first_p1")).select(F.col("first_p0").alias("p0"), F.col("first_p1").alias("p1"), F.col("p1").alias("again"))
    counts = both.where("p1 IS NOT NULL").agg(
        F.lit(again.stages[-1].getNumTrees).cast("int").alias("n_trees"),
        F.count("*").alias("n_predicted"),
        F.count_if(F.col("p1") == F.col("again")).alias("n_same"),
        F.count_if(F.abs(F.col("p0") + F.col("p1") - 1) < 1e-9).alias("n_whole"),
    )
    return counts.crossJoin(F.broadcast(table.agg(F.count("*").alias("n_rows")))).select("n_trees", "n_rows", "n_predicted", "n_same", "n_whole")


@query()
def forest_levels(spark, sf_dir):
    """Two tiles that share eight columns, mosaicked and cut at every threshold."""
    f, train, _ = _split(spark, sf_dir)
    model = T.train_forest(T.training_table(train), FEATURES)
    half = D.WIDTH // 2
    return W.forest_levels(model, [f.where(F.col("col") < half + 4), f.where(F.col("col") >= half - 4)])
