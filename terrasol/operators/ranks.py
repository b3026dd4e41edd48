"""Ranks over a whole table, and random permutations built on them, without a partition that holds everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasol.operators.grid import small
from terrasol.sources.store import cut

#: rows of a range partition
RANGE_ROWS = 1 << 16


def ranked(df: DataFrame, order: list[str], name: str = "rank", by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Adds each row's place from 0 on in the order of the named columns (and `n`, the number of rows), within `by` if given.

    Groups of up to RANGE_ROWS rows are ordered each by itself, all in one shuffle.  Rows of larger ones, and of a table without groups, are dealt to
    range partitions, the partitions' counts are added up (a small table), and every row has its place in its
    partition added.  With `weight`, a row stands for so many rows: its place is that of the first of them, and n their number.
    Rows equal in all named columns share a partition and follow one another; NULLs come first."""
    whole = cut(df)
    if not by:
        return _in_ranges(whole, order, name, by, weight)
    one = F.col(weight) if weight else F.lit(1).cast("bigint")
    mine = Window.partitionBy(*by)
    before = mine.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    each = lambda df: df.withColumns({name: F.coalesce(F.sum(one).over(before), F.lit(0)).cast("bigint"), "n": F.sum(one).over(mine)})
    # at most one in RANGE_ROWS rows makes a large group
    large = cut(whole.groupBy(*by).agg(F.count("*").alias("_rank_c")).where(F.col("_rank_c") > RANGE_ROWS).select(*(F.col(k).alias(f"_rank_k{i}") for i, k in enumerate(by))))
    if not large.limit(1).count():
        return each(whole)
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_rank_k{i}"))
    large = small(large)
    far = _in_ranges(cut(whole.join(large, same, "left_semi")), order, name, by, weight)
    return each(whole.join(large, same, "left_anti")).unionByName(far)


def _in_ranges(whole: DataFrame, order: list[str], name: str, by: tuple[str, ...], weight: str | None) -> DataFrame:
    parts = max(1, -(-whole.count() // RANGE_ROWS))
    one = F.col(weight) if weight else F.lit(1).cast("bigint")
    dealt = cut(whole.repartitionByRange(parts, *by, *order).withColumn("_rank_part", F.spark_partition_id()))
    keys = [*by, "_rank_part"]
    before = Window.partitionBy(*by).orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys).agg(F.sum(one).alias("_rank_c"))
    counts = counts.select(*keys, F.coalesce(F.sum("_rank_c").over(before), F.lit(0)).alias("_rank_before"), F.sum("_rank_c").over(Window.partitionBy(*by)).alias("n"))
    renamed = counts.select(*(F.col(k).alias(f"_rank_k{i}") for i, k in enumerate(keys)), "_rank_before", "n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_rank_k{i}"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = (F.col("_rank_before") + F.coalesce(F.sum(one).over(inside), F.lit(0))).cast("bigint")
    return dealt.join(small(renamed), same).withColumn(name, place).drop("_rank_part", "_rank_before", *(f"_rank_k{i}" for i in range(len(keys))))


def permuted(df: DataFrame, columns: list[str], key: str, seed: int = 42, prefix: str = "_p_") -> DataFrame:
    """Every row beside the named values of a partner (prefix + name): a random permutation of the table, fixed by the seed
    and the rows' own text, whatever the partitions.

    The row of place i by key gets the values of the row of place i by md5(seed, key); ties go by the values."""
    hashed = df.select(key, *columns, F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary")).alias("_h"))
    here = ranked(df, [key, *columns], "_place").drop("n")
    there = ranked(hashed, ["_h", key, *columns], "_place").select("_place", *(F.col(c).alias(prefix + c) for c in columns))
    return here.join(there, "_place").drop("_place")
