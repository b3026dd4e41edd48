"""Zonal statistics, filters and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasol.operators.selection import FEW, group_quantile


def zonal_mean(cells: DataFrame, zone: str, bands: list[str]) -> DataFrame:
    """Mean of each band per zone in one aggregation; NULLs and the NULL zone are left out."""
    return cells.where(F.col(zone).isNotNull()).groupBy(zone).agg(*(F.avg(b).alias(b) for b in bands))


def zonal_quantile(cells: DataFrame, zone: str, band: str, p: float = 0.1, few: int = FEW) -> DataFrame:
    """Quantile with linear interpolation between the two nearest values; zones of any size."""
    return group_quantile(cells.where(F.col(zone).isNotNull()), zone, band, p, few)


def zonal_stats(cells: DataFrame, zone: str, band: str, prefix: str = "dens_") -> DataFrame:
    return cells.where(F.col(zone).isNotNull()).groupBy(zone).agg(F.count(band).alias(f"{prefix}count"), F.sum(band).alias(f"{prefix}sum"), F.avg(band).alias(f"{prefix}mean"))


def zone_sizes(cells: DataFrame, zone: str) -> DataFrame:
    return cells.where(F.col(zone).isNotNull()).groupBy(zone).agg(F.count("*").alias("pixels"))


def merge_zone_stats(tables: list[DataFrame], zone: str, how: str = "inner") -> DataFrame:
    """Per-zone tables side by side: inner, or left to keep all zones of the first."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, zone, how)
    return out


# Strict bounds of the object filter.
EXPERT = {"slope": (4, 16), "aspect": (130, 240), "tpi": (0.05, 0.7), "pixels": (5, 2000)}


def expert_filter(zones: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Zones strictly inside all bounds."""
    keep = F.lit(True)
    for c, (low, high) in (bounds or EXPERT).items():
        keep = keep & (F.col(c) > low) & (F.col(c) < high)
    return zones.where(keep)


def mask_zones(cells: DataFrame, zone: str, chosen: DataFrame) -> DataFrame:
    """1 where the zone is chosen, else NULL."""
    ids = chosen.select(F.col(zone).alias("_z")).distinct().withColumn("value", F.lit(1))
    return cells.join(ids, F.col(zone) == F.col("_z"), "left").select("row", "col", "value")


def zone_table(cells: DataFrame, zone: str, bands: list[str]) -> DataFrame:
    """Means and size of every zone in one pass."""
    return cells.where(F.col(zone).isNotNull()).groupBy(zone).agg(*(F.avg(b).alias(b) for b in bands), F.count("*").alias("pixels"))


def class_distribution(cells: DataFrame, label: str) -> DataFrame:
    """Count and percent of each class; the total is the sum over the few class rows."""
    counts = cells.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", F.round(F.col("n") * 100.0 / F.col("_t"), 2).alias("percent"))


def class_ratio(cells: DataFrame, label: str) -> DataFrame:
    """Class 1 over class 0, cells, and distinct classes other than 0."""
    one, zero = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return cells.agg(F.round(F.try_divide(one.cast("double"), zero.cast("double")), 3).alias("ratio"), F.count(label).alias("cells"), F.count_distinct(F.nullif(F.col(label), F.lit(0))).alias("classes"))


def raster_stats(cells: DataFrame, band: str) -> DataFrame:
    """NoData, least, greatest, mean, covered cells and percent in one aggregation."""
    return cells.agg(
        F.count_if(F.col(band).isNull()).alias("missing"),
        F.min(band).alias("least"),
        F.max(band).alias("most"),
        F.round(F.avg(band), 6).alias("mean"),
        F.count(band).alias("covered"),
        F.round(F.try_divide(F.count(band) * 100.0, F.count("*").cast("double")), 2).alias("percent"),
    )


def total_area(patches: DataFrame, area: str = "area") -> DataFrame:
    return patches.agg(F.coalesce(F.round(F.sum(area), 2), F.lit(0.0)).alias("total_area"))


def filter_report(rows: DataFrame, layer: str, steps: dict[str, Column]) -> DataFrame:
    """Rows in, and removed and left after each filter in turn, per layer, in one pass."""
    out, kept = [F.count("*").alias("rows_in")], F.lit(True)
    before = F.count("*")
    for name, keep in steps.items():
        kept = kept & F.coalesce(keep, F.lit(False))
        left = F.count_if(kept)
        out += [(before - left).alias(f"removed_{name}"), left.alias(f"left_{name}")]
        before = left
    return rows.groupBy(layer).agg(*out)
