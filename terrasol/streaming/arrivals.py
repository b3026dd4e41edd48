"""Cells that arrive as files: zone statistics kept up to date by a stream.

The source material is batch only; this is the same zonal aggregation for a folder that tiles are
still being written to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving_cells(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Cell files of a folder as a stream, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_zone_stats(cells: DataFrame, zone: str, band: str) -> DataFrame:
    """Count, sum and mean per zone over all that has arrived; the state is one row per zone."""
    return cells.where(F.col(zone).isNotNull()).groupBy(zone).agg(F.count(band).alias("count"), F.sum(band).alias("sum"), F.avg(band).alias("mean"))


def keep_zone_stats(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Replaces the statistics at `path` after every trigger, and ends when the folder is read."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stats.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
