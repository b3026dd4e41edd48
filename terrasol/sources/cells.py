"""Sources and sinks: cell tables, tile catalogues, legends, patch layers, job reports.

A raster is a cell table: one row per cell (`row` grows southwards, `col` eastwards), one column
per band.  NULL is NoData; a missing row is a cell with all bands NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasol.sources.store import cut

KEY = ("row", "col")
OUTCOME = "tile string, path string, status string, n bigint, message string"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any float column becomes NULL."""
    fractions = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in fractions else F.col(c) for c in df.columns))


def read_cells(spark: SparkSession, path: str, bands: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A raster's cell table with the named bands; the scan reads no other column."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    keep = [c for c in ("grid_id", *KEY) if c in df.columns]
    missing = set(bands or ()) - set(df.columns)
    if missing:
        raise ValueError(f"no such bands: {sorted(missing)}")
    return nan_to_null(df.select(*keep, *(bands or [c for c in df.columns if c not in keep])))


def write_cells(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replaces the raster at `path`."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files under a folder, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def discover_tiles(paths: DataFrame, pattern: str) -> DataFrame:
    """(tile, path): the first file by name whose name matches, for each folder that has one."""
    named = paths.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), -2).alias("tile"))
    return named.where(F.col("file").rlike(pattern)).groupBy("tile").agg(F.min("path").alias("path"))


def tiles_without(paths: DataFrame, pattern: str) -> DataFrame:
    """Folders without a matching file."""
    every = paths.select(F.element_at(F.split("path", "/"), -2).alias("tile")).distinct()
    return every.join(discover_tiles(paths, pattern), "tile", "left_anti")


def hex_channel(color: Column, at: int) -> Column:
    return F.conv(F.substring(color, 1 + 2 * at, 2), 16, 10).cast("int")


def legend(raw: DataFrame) -> DataFrame:
    """(value, class_id, label, r, g, b) of legends with arrays values, palette, label; classes count from 1."""
    each = raw.select(F.posexplode(F.arrays_zip("values", "palette", "label")).alias("k", "e"))
    color = F.regexp_replace(F.col("e.palette"), "^#", "")
    return each.select(F.col("e.values").cast("int").alias("value"), (F.col("k") + 1).alias("class_id"), F.col("e.label").alias("label"), *(hex_channel(color, i).alias(c) for i, c in enumerate("rgb")))


def read_legend(spark: SparkSession, path: str) -> DataFrame:
    return legend(spark.read.schema("values array<int>, palette array<string>, label array<string>").json(path, multiLine=True))


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_patches(patches: DataFrame, path: str) -> None:
    patches.write.mode("overwrite").parquet(path)


def tile_report(outcomes: DataFrame) -> DataFrame:
    """(status, tiles, items): how many tiles ended OK or with an error, of rows (tile, status, n, message)."""
    return outcomes.groupBy("status").agg(F.count("*").alias("tiles"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"))


def per_tile(cells: DataFrame, tile_col: str, work, out_band: str = "v") -> DataFrame:
    """Runs `work` (a function of a tile's Arrow table to a row count) on each tile; an error is caught
    on its tile and reported, the others go on: (tile, status, n, message)."""
    import pyarrow as pa

    def run(data: pa.Table) -> pa.Table:
        name = data[tile_col][0].as_py()
        try:
            row = (name, "OK", int(work(data)), None)
        except Exception as error:  # the report is the point: one bad tile must not stop the rest
            row = (name, "ERREUR", None, str(error))
        return pa.table({"tile": [row[0]], "status": [row[1]], "n": pa.array([row[2]], pa.int64()), "message": pa.array([row[3]], pa.string())})

    return cells.groupBy(tile_col).applyInArrow(run, "tile string, status string, n bigint, message string")


def file_outcomes(spark: SparkSession, folder: str, pattern: str, work=None) -> DataFrame:
    """(tile, path, status, n, message) of every folder below `folder`: the first file whose name matches is read as a Parquet
    tile inside a task and handed to `work` (a function of an Arrow table to a count; the rows by default).

    A file that cannot be read, or on which the work fails, is reported as ERREUR with the whole message and stops no other
    tile; a folder without a matching file is reported as MANQUANT.  A task holds one tile's file at a time."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    paths = cut(file_catalog(spark, folder))
    chosen = discover_tiles(paths, pattern)
    # a file that the file system itself cannot give is left out here and missed below
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for tile, path, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    if data is None:
                        raise OSError(f"{path} could not be read")
                    table = pq.read_table(pa.BufferReader(data))
                    row = (tile, path, "OK", int(work(table) if work else table.num_rows), None)
                except Exception as error:  # the report is the point: one bad tile must not stop the rest
                    row = (tile, path, "ERREUR", None, f"{type(error).__name__}: {error}")
                yield pa.RecordBatch.from_pydict({"tile": [row[0]], "path": [row[1]], "status": [row[2]], "n": pa.array([row[3]], pa.int64()), "message": pa.array([row[4]], pa.string())})

    opened = chosen.join(content, "path", "left").select("tile", "path", "content").mapInArrow(run, OUTCOME)
    missing = tiles_without(paths, pattern)
    return opened.unionByName(missing.select("tile", F.lit(None).cast("string").alias("path"), F.lit("MANQUANT").alias("status"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("message")))
