from pyspark.sql import functions as F

from terrasol.sources.store import new_path
from terrasol.streaming.arrivals import arriving_cells, keep_zone_stats, running_zone_stats


def test_stream_equals_batch(spark):
    cells = spark.range(1000).select((F.col("id") % 7).alias("zone"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    source, out = new_path(spark), new_path(spark)
    cells.repartition(6).write.parquet(source)
    stream = running_zone_stats(arriving_cells(spark, source, cells.schema, 2), "zone", "v")
    keep_zone_stats(stream, out, new_path(spark)).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select("zone", "count", "sum", "mean").collect())) == sorted(map(tuple, running_zone_stats(cells, "zone", "v").collect()))
