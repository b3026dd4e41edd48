"""Grids derived from the star-schema tables, with integer bands so that sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: columns of the derived grid
WIDTH = 100


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A south-facing stair of terraces: row, col, elev_cm, nir, red, label, zone_id.  Orders
    without line items are NoData in the line bands."""
    li = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy("l_orderkey")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("nir"), F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("red"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("label"))
    )
    k = F.col("o_orderkey")
    row, col = F.floor(k / WIDTH).cast("int"), (k % WIDTH).cast("int")
    elev = F.lit(100000) - 400 * F.floor(k / 800) - 5 * (F.floor(k / 100) % 8) - F.when(k % WIDTH % 17 == 0, 300).otherwise(0) + F.round(F.col("o_totalprice") * 100).cast("bigint") % 161
    zone = F.floor((F.floor(k / 100) + 2) / 4) * 1000 + F.floor(k % 100 / 4)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    # both sides grow with the input: none is sent to all tasks by way of the driver
    return orders.join(li.hint("merge"), F.col("l_orderkey") == k, "left").select(row.alias("row"), col.alias("col"), elev.cast("bigint").alias("elev_cm"), "nir", "red", "label", zone.cast("bigint").alias("zone_id"))


CELLS_SQL = """li AS (SELECT l_orderkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS nir, CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS BIGINT) AS red,
             MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label FROM lineitem GROUP BY l_orderkey),
cells AS (SELECT CAST(o_orderkey // 100 AS INT) AS r, CAST(o_orderkey % 100 AS INT) AS c,
             CAST(100000 - 400 * (o_orderkey // 800) - 5 * ((o_orderkey // 100) % 8) - CASE WHEN (o_orderkey % 100) % 17 = 0 THEN 300 ELSE 0 END + CAST(ROUND(o_totalprice * 100) AS BIGINT) % 161 AS BIGINT) AS elev_cm,
             nir, red, label, CAST((((o_orderkey // 100) + 2) // 4) * 1000 + ((o_orderkey % 100) // 4) AS BIGINT) AS zone_id
          FROM orders LEFT JOIN li ON l_orderkey = o_orderkey)"""


def two_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rasters in one table with the same cell numbers: the grid (a), and its mirror image on a slope with every eleventh row missing (b)."""
    a = cells(spark, sf_dir)
    b = a.where("row % 11 <> 5").withColumn("elev_cm", F.col("elev_cm") + F.col("col") * 10).withColumn("col", F.lit(WIDTH - 1) - F.col("col"))
    return a.withColumn("grid_id", F.lit("a")).unionByName(b.withColumn("grid_id", F.lit("b")))


#: the second grid, under the name of the first
CELLS_B_SQL = CELLS_SQL.replace("cells AS (", "cells0 AS (") + ", cells AS (SELECT r, 99 - c AS c, elev_cm + c * 10 AS elev_cm, nir, red, label, zone_id FROM cells0 WHERE r % 11 <> 5)"


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, p0, p1 on the same cells."""
    k = F.col("o_orderkey")
    p1 = (F.round(F.col("o_totalprice") * 100).cast("bigint") % 1001) / F.lit(1000.0)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(k / WIDTH).cast("int").alias("row"), (k % WIDTH).cast("int").alias("col"), (1 - p1).alias("p0"), p1.alias("p1"))


PROB_SQL = """prob AS (SELECT CAST(o_orderkey // 100 AS INT) AS r, CAST(o_orderkey % 100 AS INT) AS c, 1 - (CAST(ROUND(o_totalprice * 100) AS BIGINT) % 1001) / 1000.0::DOUBLE AS p0,
             (CAST(ROUND(o_totalprice * 100) AS BIGINT) % 1001) / 1000.0::DOUBLE AS p1 FROM orders)"""


def terrace_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, p1: high in L-shaped terraces of 8 by 15 cells on a pattern of 12 by 20, low between them, with noise."""
    k = F.col("o_orderkey")
    row, col = F.floor(k / WIDTH).cast("int"), (k % WIDTH).cast("int")
    r, c = row % 12, col % 20
    inside = (r < 8) & (c < 15) & ~((r < 4) & (c >= 8))
    noise = F.round(F.col("o_totalprice") * 100).cast("bigint")
    p1 = F.when(inside, (noise % 801 + 200) / F.lit(1000.0)).otherwise(noise % 301 / F.lit(1000.0))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(row.alias("row"), col.alias("col"), p1.alias("p1"))


TERRACE_SQL = """terr AS (SELECT r, c, CASE WHEN r % 12 < 8 AND c % 20 < 15 AND NOT (r % 12 < 4 AND c % 20 >= 8) THEN m % 801 + 200 ELSE m % 301 END AS p
             FROM (SELECT CAST(o_orderkey // 100 AS INT) AS r, CAST(o_orderkey % 100 AS INT) AS c, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS m FROM orders))"""


def embedding_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row = vec_id, col = position, v, cls = label."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(F.col("vec_id").cast("int").alias("row"), F.col("label").alias("cls"), F.posexplode("embedding").alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("v"), "cls")


EMB_SQL = """emb AS (SELECT CAST(vec_id AS INT) AS r, label AS cls, unnest(range(0, len(embedding))) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


def tiles(spark: SparkSession, sf_dir: str, width: int = 64, height: int = 32, overlap: int = 8) -> DataFrame:
    """Overlapping tile boxes over the grid: name, xmin, ymin, xmax, ymax (metres; y falls southwards from 0)."""
    size = cells(spark, sf_dir).agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    each = size.select("h", "w", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 1) / height).cast("int"))).alias("i")).select("h", "w", "i", F.explode(F.sequence(F.lit(0), F.floor((F.col("w") - 1) / width).cast("int"))).alias("j"))
    x, y = F.col("j") * width, F.col("i") * height
    return each.select(
        F.format_string("T%02d_%02d", "i", "j").alias("name"),
        x.cast("double").alias("xmin"),
        (-F.least(y + height + overlap, F.col("h"))).cast("double").alias("ymin"),
        F.least(x + width + overlap, F.col("w")).cast("double").alias("xmax"),
        (-y).cast("double").alias("ymax"),
    )


TILES_SQL = """tiles AS (SELECT format('T{:02d}_{:02d}', i, j) AS name, CAST(j * 64 AS DOUBLE) AS xmin, CAST(-least(i * 32 + 40, h) AS DOUBLE) AS ymin, CAST(least(j * 64 + 72, w) AS DOUBLE) AS xmax, CAST(-i * 32 AS DOUBLE) AS ymax
          FROM (SELECT h, w, i, unnest(range(0, (w - 1) // 64 + 1)) AS j FROM (SELECT h, w, unnest(range(0, (h - 1) // 32 + 1)) AS i FROM (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells))))"""
