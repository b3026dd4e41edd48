"""Landscape scenarios and how much their results agree."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasol.operators import focal as N
from terrasol.operators import patches as P
from terrasol.operators.grid import small
from terrasol.sources.store import cut


def sensitivity_grid(low: tuple = (10, 15, 20), steep: tuple = (25, 30, 35), buffers: tuple = (10,)) -> list[tuple[str, float, float, float]]:
    """Scenarios (id, low_max, steep_min, buffer); those whose low bound reaches the steep one are skipped."""
    return [(f"{a}_{b}" + (f"_{d}" if len(buffers) > 1 else ""), float(a), float(b), float(d)) for a in low for b in steep for d in buffers if a < b]


def scenario_areas(slopes: DataFrame, scenarios: list[tuple[str, float, float, float]], ncols: int, least: float = 5.0, density: tuple[float, float] = (0.3, 0.6), half: int = 20, res: float = 1.0) -> DataFrame:
    """(scenario_id, patch_id, row, col) of the patches each scenario selects.

    The parts that scenarios share are made once: a low mask and its patches for each low bound, a steep mask for each steep
    bound, the densities of all steep bounds side by side in one pass; patches of every low bound meet the cells of every steep
    bound, so cells are not repeated for scenarios.  Only selection is made per scenario."""
    spark = slopes.sparkSession
    table = spark.createDataFrame(scenarios, "scenario_id string, low_max double, steep_min double, buffer double")
    lows, steeps = sorted({s[1] for s in scenarios}), sorted({s[2] for s in scenarios})
    bound = lambda values, name: F.explode(F.array(*(F.lit(v) for v in values))).alias(name)
    known = slopes.where(F.col("slope").isNotNull())
    low = known.select("row", "col", "slope", bound(lows, "low_max")).where(F.col("slope") <= F.col("low_max")).withColumn("one", F.lit(1))
    labelled = cut(P.label_runs(low, "one", ncols, 4, ("low_max",)))
    large = P.min_area_filter(P.patch_area(labelled, res, ("low_max",)), least).select("low_max", "patch_id")
    low_cells = cut(P.run_cells(labelled, ("low_max",)).join(large, ["low_max", "patch_id"]))
    steep_cells = known.select("row", "col", "slope", bound(steeps, "steep_min")).where(F.col("slope") >= F.col("steep_min")).select("steep_min", "row", "col")
    near = None
    for d in sorted({s[3] for s in scenarios}):
        mine = small(table.where(F.col("buffer") == d).select("scenario_id", "low_max", "steep_min"))
        got = P.near_patches(low_cells, steep_cells, d, res, low_by=("low_max",), steep_by=("steep_min",)).join(mine, ["low_max", "steep_min"])
        near = got if near is None else near.unionByName(got)
    near = cut(near)
    # mean density of each patch under every steep bound, from one pass over the cells
    masks = known.select("row", "col", *(F.when(F.col("slope") >= v, 1).otherwise(0).alias(f"steep{i}") for i, v in enumerate(steeps)))
    found = low_cells.join(N.local_densities(masks, [f"steep{i}" for i in range(len(steeps))], half), ["row", "col"])
    means = found.groupBy("low_max", "patch_id").agg(*(F.avg(f"steep{i}").alias(f"steep{i}") for i in range(len(steeps))))
    means = means.select("low_max", "patch_id", F.inline(F.array(*(F.struct(F.lit(v).alias("steep_min"), F.col(f"steep{i}").alias("dens_mean")) for i, v in enumerate(steeps)))))
    kept = P.density_select(near.join(means, ["low_max", "steep_min", "patch_id"]), *density).select("scenario_id", "low_max", "patch_id")
    return kept.join(low_cells, ["low_max", "patch_id"]).select("scenario_id", "patch_id", "row", "col")


def landscape_scenario(cells: DataFrame, band: str, ncols: int, low: float = 15, steep: float = 25, buffer: float = 20, res: float = 1.0, least: float = 5.0, density: tuple[float, float] = (0.3, 0.6), half: int = 20) -> DataFrame:
    """The whole workflow for one set of bounds: (patch_id, area)."""
    slopes = cut(N.slope_with_edges(cells, band, res))
    got = scenario_areas(slopes, [("one", float(low), float(steep), float(buffer))], ncols, least, density, half, res)
    return got.groupBy("patch_id").agg((F.count("*") * res * res).alias("area"))


def pairs_of(scenarios: list[tuple[str, float, float, float]], one_apart: bool) -> list[tuple[str, str]]:
    """All pairs, or those that differ in exactly one of the two slope bounds."""
    return [(a[0], b[0]) for a, b in combinations(scenarios, 2) if not one_apart or (a[1] != b[1]) != (a[2] != b[2])]


def jaccard_pairs(selected: DataFrame, scenarios: list[tuple[str, float, float, float]], one_apart: bool = True, res: float = 1.0) -> DataFrame:
    """(a, b, inter, union, jaccard): areas shared by two scenarios' patches; 0 if the union is empty.

    One pass over the cells: each cell becomes the set of scenarios that hold it, as bits, and
    the few different sets are counted; pairs are then taken from those counts, not from cells."""
    if len(scenarios) > 62:
        raise ValueError("at most 62 scenarios fit the bits")
    bit = F.lit(None).cast("bigint")
    for k, s in enumerate(scenarios):
        bit = F.when(F.col("scenario_id") == s[0], F.lit(1 << k)).otherwise(bit)
    sets = selected.select("row", "col", bit.alias("b")).groupBy("row", "col").agg(F.bit_or("b").alias("set")).groupBy("set").agg(F.count("*").alias("n"))
    number = {s[0]: k for k, s in enumerate(scenarios)}
    has = lambda k: F.expr(f"(set & {1 << k}L) <> 0")
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), has(number[a]).alias("in_a"), has(number[b]).alias("in_b")) for a, b in pairs_of(scenarios, one_apart)))
    both = sets.select("n", F.explode(each).alias("p")).groupBy("p.a", "p.b").agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(n) for n, c in (("inter", F.col("p.in_a") & F.col("p.in_b")), ("union", F.col("p.in_a") | F.col("p.in_b")))))
    return both.select("a", "b", (F.col("inter") * res * res).alias("inter"), (F.col("union") * res * res).alias("union"), F.round(F.coalesce(F.try_divide(F.col("inter").cast("double"), F.col("union").cast("double")), F.lit(0.0)), 3).alias("jaccard"))
