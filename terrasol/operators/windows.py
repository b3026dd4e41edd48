"""Windows for learning, and weighted merges of what models say about them."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_patches(cells: DataFrame, bands: list[str], mask: str = "cls", patch: int = 128, wanted: int = 2) -> DataFrame:
    """(wr, wc) of the whole, non-overlapping windows that hold the wanted class and no NoData, by one aggregation."""
    whole = F.count("*") == patch * patch
    empty = reduce(lambda a, b: a | b, (F.col(b).isNull() for b in bands))
    stats = cells.groupBy(F.floor(F.col("row") / patch).cast("int").alias("wr"), F.floor(F.col("col") / patch).cast("int").alias("wc")).agg(whole.alias("whole"), F.bool_or(F.coalesce(F.col(mask) == wanted, F.lit(False))).alias("has"), F.bool_or(empty).alias("empty"))
    return stats.where("whole and has and not empty").select("wr", "wc")


def number_patches(windows: DataFrame, offset: int = 725) -> DataFrame:
    """Numbers in reading order from offset + 1 on.  The order is global, over the small table of windows: rows
    are counted per window row first, so no task sees more than one row of windows."""
    per_row = windows.groupBy("wr").agg(F.count("*").alias("n"))
    before = per_row.select("wr", (F.sum("n").over(Window.orderBy("wr")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("wr").orderBy("wc"))
    return windows.join(before, "wr").select("wr", "wc", (F.col("before") + inside + offset).cast("int").alias("number"))


def pack_windows(cells: DataFrame, keys: list[str], bands: list[str], position: Column) -> DataFrame:
    """Each window's values as one array per band, in order of position."""
    packed = cells.select(*keys, position.alias("_p"), *bands).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", *bands))).alias("_c"))
    return packed.select(*keys, *(F.col(f"_c.{b}").alias(b) for b in bands))


def negative_patches(cells: DataFrame, bands: list[str], mask: str = "cls", patch: int = 128, count: int = 200, tries: int = 100_000, seed: int = 42) -> DataFrame:
    """Up to `count` windows at random places with neither the wanted class 2 nor unknown 0 nor NoData: the least
    hashes of (seed, try) that qualify, so the choice does not depend on partitions."""
    size = F.broadcast(cells.agg((F.max("row") - patch + 2).alias("h"), (F.max("col") - patch + 2).alias("w")))
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "id")
    places = cells.sparkSession.range(tries).crossJoin(size).where("h > 0 and w > 0").select("id", F.pmod(draw(1), F.col("h")).cast("int").alias("r0"), F.pmod(draw(2), F.col("w")).cast("int").alias("c0"))
    bad = reduce(lambda a, b: a | b, (F.col(b).isNull() for b in bands), F.coalesce(F.col(mask), F.lit(0)).isin(0, 2))
    spoiled = cells.where(bad).select("row", "col")
    # a place is out if a spoiled cell lies in it: places meet spoiled cells by bins of the patch size
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) / patch), F.floor((F.col(c) + patch - 1) / patch)))
    binned = places.withColumn("_br", span("r0")).withColumn("_bc", span("c0"))
    met = binned.join(spoiled.withColumn("_br", F.floor(F.col("row") / patch)).withColumn("_bc", F.floor(F.col("col") / patch)), ["_br", "_bc"]).where((F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r0") + patch) & (F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c0") + patch))
    return places.join(met.select("id").distinct(), "id", "left_anti").orderBy("id").limit(count).select("id", "r0", "c0")


def covering(at: Column, size: Column, patch: int, stride: int) -> Column:
    """Starts of the whole windows over index `at` of an axis of `size` cells."""
    low = F.greatest(F.ceil((at - patch + 1) / stride), F.lit(0)) * stride
    high = F.floor(F.least(at, size - patch) / stride) * stride
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"), F.lit(stride))).otherwise(F.expr("cast(array() as array<int>)"))


def overlap_windows(cells: DataFrame, patch: int = 128, stride: int = 64) -> DataFrame:
    """Each cell with every whole overlapping window (i, j) that covers it; windows that do not fit are left out."""
    size = F.broadcast(cells.agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w")))
    spread = cells.crossJoin(size).withColumn("i", F.explode(covering(F.col("row"), F.col("_h"), patch, stride))).withColumn("j", F.explode(covering(F.col("col"), F.col("_w"), patch, stride)))
    return spread.drop("_h", "_w")


def window_validity(windowed: DataFrame, bands: list[str], key_band: str | None = None) -> DataFrame:
    """(i, j, reason): why a window is dropped, in this order: NoData or infinity, all zero, key band all zero; else ok."""
    key_band = key_band or bands[min(4, len(bands) - 1)]
    bad = reduce(lambda a, b: a | b, (F.col(b).isNull() | F.col(b).cast("double").isin(float("inf"), float("-inf")) for b in bands))
    full = reduce(lambda a, b: a | b, (F.coalesce(F.col(b) != 0, F.lit(False)) for b in bands))
    stats = windowed.groupBy("i", "j").agg(F.bool_or(bad).alias("bad"), F.bool_or(full).alias("full"), F.bool_or(F.coalesce(F.col(key_band) != 0, F.lit(False))).alias("key"))
    return stats.select("i", "j", F.when(F.col("bad"), "nodata").when(~F.col("full"), "zero").when(~F.col("key"), "key_zero").otherwise("ok").alias("reason"))


def score_windows(packed: DataFrame, bands: list[str], classes: int, load: Callable[[], Callable], patch: int) -> DataFrame:
    """(i, j, probs): class probabilities of every window by a user's model.

    load() is called once per task and returns a function from the bands' arrays of a window to patch * patch *
    classes numbers; another length is an error.  Windows of a task share small Arrow batches."""
    want = patch * patch * classes

    def run(batches):
        model = load()
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                part = batch.slice(k, 16)
                out = []
                for row in part.select(bands).to_pylist():
                    probs = list(model({b: row[b] for b in bands}))
                    if len(probs) != want:
                        raise ValueError(f"the model gave {len(probs)} numbers, not {want}")
                    out.append(probs)
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("j"), pa.array(out, pa.list_(pa.float32()))], ["i", "j", "probs"])

    return packed.select("i", "j", *bands).mapInArrow(run, "i int, j int, probs array<float>")


def scored_cells(scores: DataFrame, patch: int, classes: int) -> DataFrame:
    """(i, j, row, col, p0 ...) of scored windows, classes as columns."""
    each = scores.select("i", "j", "probs", F.explode(F.sequence(F.lit(0), F.lit(patch * patch - 1))).alias("k"))
    return each.select("i", "j", (F.col("i") + F.floor(F.col("k") / patch)).cast("int").alias("row"), (F.col("j") + F.col("k") % patch).cast("int").alias("col"), *(F.get("probs", F.col("k") * classes + c).cast("double").alias(f"p{c}") for c in range(classes)))


def hann(k: Column, n: int) -> Column:
    """Symmetric Hann weight; 0 at both ends."""
    return F.lit(0.5) - 0.5 * F.cos(k * (2 * math.pi / (n - 1)))


def hann_merge(windowed: DataFrame, probs: list[str], patch: int = 128) -> DataFrame:
    """Weighted mean of overlapping windows per cell; NULL where only weight 0 falls (uncovered).  Classes are columns, so
    a cell is one group."""
    w = hann(F.col("row") - F.col("i"), patch) * hann(F.col("col") - F.col("j"), patch)
    weighed = windowed.withColumn("_w", w)
    enough = F.sum("_w") > 1e-12
    return weighed.groupBy("row", "col").agg(*(F.when(enough, F.sum(F.col("_w") * F.col(p)) / F.sum("_w")).alias(p) for p in probs))


def max_prob_mosaic(windowed: DataFrame, probs: list[str], patch: int = 128) -> DataFrame:
    """Hann-weighted mean of each window's greatest class probability; 0 without weight."""
    best = windowed.select("i", "j", "row", "col", (F.greatest(*probs) if len(probs) > 1 else F.col(probs[0])).alias("p"))
    return hann_merge(best, ["p"], patch).select("row", "col", F.coalesce("p", F.lit(0.0)).alias("p"))


def taper(k: Column, n: Column, border: int) -> Column:
    """1 inside, half a Hann over the outer cells of a strip."""
    rise = lambda x: F.lit(0.5) - 0.5 * F.cos(x * (2 * math.pi / (2 * border - 1)))
    return F.when(k < border, rise(k)).when(k >= n - border, rise(n - 1 - k)).otherwise(1.0)


def edge_taper_merge(strips: DataFrame, value: str = "v", border: int = 30) -> DataFrame:
    """Weighted mean of strips (columns offset, wide, row, col in the mosaic), truncated to whole codes; 0 without weight."""
    w = taper(F.col("col") - F.col("offset"), F.col("wide"), border)
    merged = strips.withColumn("_w", w).groupBy("row", "col").agg(F.sum(F.col("_w") * F.col(value)).alias("_s"), F.sum(F.when(F.col(value).isNotNull(), F.col("_w"))).alias("_t"))
    return merged.select("row", "col", F.when(F.col("_t") > 1e-12, F.floor(F.round(F.col("_s") / F.col("_t"), 9))).otherwise(0).cast("int").alias(value))
