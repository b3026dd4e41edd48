"""Blocks with a halo: the bridge between cell tables and two-dimensional arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grids(cells: DataFrame) -> tuple[str, ...]:
    """The key of a table that holds several rasters: ("grid_id",), or nothing for one raster."""
    return ("grid_id",) if "grid_id" in cells.columns else ()


def place(cells: DataFrame) -> list[str]:
    """Key columns of a cell."""
    return [*grids(cells), "row", "col"]


def extents(cells: DataFrame) -> DataFrame:
    """First and last row and column (r0, r1, c0, c1) of each grid."""
    return cells.groupBy(*grids(cells)).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))


def to_blocks(cells: DataFrame, size: int, halo: int) -> DataFrame:
    """Each cell with every block that needs it (block_row, block_col): its own and those whose halo it is in."""
    lo = lambda c: F.floor((F.col(c) - halo) / size)
    hi = lambda c: F.floor((F.col(c) + halo) / size)
    return cells.withColumn("block_row", F.explode(F.sequence(lo("row"), hi("row")))).withColumn("block_col", F.explode(F.sequence(lo("col"), hi("col"))))


def by_block(cells: DataFrame, bands: list[str], halo: int, made: dict[str, Callable[[dict], np.ndarray]], size: int = 512) -> DataFrame:
    """Applies array functions to every block with its halo and returns (row, col, made...) of the given cells, with grid_id if they have it.

    One shuffle by block (of each grid); a task holds one block of size + 2 halo cells a side.  Missing
    cells and NULL are NaN inside, NULL outside."""

    by = grids(cells)
    kinds = "".join(f"{c} {cells.schema[c].dataType.simpleString()}, " for c in by)

    def run(data: pa.Table) -> pa.Table:
        r0, c0 = data["block_row"][0].as_py() * size - halo, data["block_col"][0].as_py() * size - halo
        row, col = data["row"].to_numpy() - r0, data["col"].to_numpy() - c0
        # only the rectangle that holds the block's cells: a narrow grid fills a small part of its blocks
        up, left = row.min(), col.min()
        grids: dict = {}
        for b in bands:
            grids[b] = np.full((row.max() - up + 1, col.max() - left + 1), np.nan)
            grids[b][row - up, col - left] = data[b].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)
        core = (row >= halo) & (row < halo + size) & (col >= halo) & (col < halo + size)
        row, col = row[core], col[core]
        out = {c: pa.chunked_array([data[c].combine_chunks().filter(pa.array(core))]) for c in by}
        out |= {"row": pa.array(row + r0, pa.int32()), "col": pa.array(col + c0, pa.int32())}
        for name, f in made.items():
            out[name] = pa.array(f(grids)[row - up, col - left], pa.float64(), from_pandas=True)
        return pa.table(out)

    blocks = to_blocks(cells.select(*place(cells), *bands), size, halo)
    return blocks.groupBy(*by, "block_row", "block_col").applyInArrow(run, kinds + "row int, col int, " + ", ".join(f"{n} double" for n in made))
