"""Exact quantiles of groups of any size: histograms of value ranges, narrowed around the rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasol.operators.grid import small
from terrasol.sources.store import cut

#: values up to which a group is finished in one buffer
FEW = 1 << 14
#: ranges of a histogram
BINS = 1024


def group_quantile(values: DataFrame, key: str, band: str, p: float, few: int = FEW, bins: int = BINS) -> DataFrame:
    """(key, quantile): the value of rank p (n - 1), interpolated between the two nearest ones; NULL values are left out, and a group
    without any has NULL.

    Groups of up to `few` values take one buffer each.  Of a larger one only counts per range are shuffled: the range that holds the
    lower rank is cut again, until it holds few values or a single one; then these, and the next value above, are
    ordered.  Every round reads the values once; a range shrinks `bins` times a round."""
    v = values.select(F.col(key).alias("_k"), F.col(band).cast("double").alias("_v"))
    sizes = cut(v.groupBy("_k").agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    large = sizes.where(F.col("n") > few)
    beside = lambda state: v.where("_v is not null").join(small(state), v["_k"].eqNullSafe(state["_z"])).drop("_z")
    named = lambda df: df.withColumnRenamed("_k", "_z")
    # groups that fit a buffer
    if not large.limit(1).count():
        return v.groupBy("_k").agg(F.percentile("_v", F.lit(p)).alias("quantile")).withColumnRenamed("_k", key)
    ready = v.join(small(named(large.select("_k"))), v["_k"].eqNullSafe(F.col("_z")), "left_anti").groupBy("_k").agg(F.percentile("_v", F.lit(p)).alias("quantile"))
    # a state row: the range [lo, hi] that holds the lower rank, the values below it (`below`) and in it (`held`)
    rank = F.floor(F.lit(p) * (F.col("n") - 1)).cast("bigint")
    state = cut(large.select("_k", "n", rank.alias("rank"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("held")))
    while True:
        wide = state.where(f"held > {few} and lo < hi")
        if not wide.limit(1).count():
            break
        inside = beside(named(wide)).where("_v between lo and hi")
        # halves first, so that a width beyond the largest number does not matter
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counted = inside.withColumn("_b", F.least(F.floor(share * bins), F.lit(bins - 1))).groupBy("_k", "n", "rank", "below", "_b").agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.col("below") + F.coalesce(F.sum("c").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        narrow = counted.withColumn("_before", before).where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("c")))
        next_ = narrow.select("_k", "n", "rank", "lo", "hi", F.col("_before").cast("bigint").alias("below"), F.col("c").cast("bigint").alias("held"))
        state = cut(next_.unionByName(state.where(f"held <= {few} or lo = hi")))
    # the different values of what is left, at most `few` of a group, and the least value above
    held = beside(named(state))
    kept = held.where("_v between lo and hi").groupBy("_k", "n", "rank", "below", "_v").agg(F.count("*").alias("c"))
    above = held.where("_v > hi").groupBy("_k", "n", "rank").agg(F.min("_v").alias("_v"), F.first("below").alias("below"), F.first("held").alias("held"))
    kept = kept.unionByName(above.select("_k", "n", "rank", (F.col("below") + F.col("held")).alias("below"), "_v", F.lit(1).cast("bigint").alias("c")).withColumn("_top", F.lit(True)), allowMissingColumns=True)
    first = F.coalesce(F.sum(F.when(F.col("_top").isNull(), F.col("c"))).over(Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kept.withColumn("_from", F.when(F.col("_top"), F.col("below")).otherwise(F.col("below") + first))
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_from") + F.col("c")), F.col("_v")))
    ends = placed.groupBy("_k").agg(at(F.col("rank")).alias("a"), at(F.col("rank") + 1).alias("b"), F.first("n").alias("n"), F.first("rank").alias("rank"))
    part = F.lit(p) * (F.col("n") - 1) - F.col("rank")
    done = ends.select("_k", F.when(part > 0, (1 - part) * F.col("a") + part * F.col("b")).otherwise(F.col("a")).alias("quantile"))
    return ready.unionByName(done).withColumnRenamed("_k", key)
