"""Grid geometry: crop, tile, mask, align, stack, mosaic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasol.operators.blocks import grids, place

#: rows up to which a table of boxes or grids is sent whole to every task
SMALL = 10_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """Marks a table for broadcast only if it has no more than `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def beside(cells: DataFrame, table: DataFrame) -> DataFrame:
    """Every cell with the row of its grid in a table of one row per grid (or one row in all)."""
    by = list(grids(cells))
    return cells.join(small(table), by) if by else cells.crossJoin(F.broadcast(table))


def crop(cells: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Cells inside an extent (ends included); the ranges reach the scan."""
    return cells.where(F.col("row").between(row0, row1) & F.col("col").between(col0, col1))


def centre(res: float = 1.0, x_min: float = 0.0, y_max: float = 0.0) -> tuple[Column, Column]:
    return F.lit(x_min) + (F.col("col") + 0.5) * res, F.lit(y_max) - (F.col("row") + 0.5) * res


def assign_tiles(cells: DataFrame, tiles: DataFrame, res: float = 1.0, x_min: float = 0.0, y_max: float = 0.0, bin_size: float = 256.0, geometry: DataFrame | None = None) -> DataFrame:
    """Every cell with each tile box that holds its centre.

    Boxes meet the cells by the bins they cover, an equi-join with the exact test behind it.  With several
    grids, `geometry` (grid_id, x_min, y_max, res_x, res_y) says where each one lies."""
    if geometry is None:
        x, y = centre(res, x_min, y_max)
        placed = cells.select("*", x.alias("_x"), y.alias("_y"))
    else:
        lie = geometry.select("grid_id", F.struct("x_min", "y_max", "res_x", "res_y").alias("_g"))
        placed = cells.join(small(lie), "grid_id").select(*cells.columns, (F.col("_g.x_min") + (F.col("col") + 0.5) * F.col("_g.res_x")).alias("_x"), (F.col("_g.y_max") - (F.col("row") + 0.5) * F.col("_g.res_y")).alias("_y"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / bin_size), F.floor(F.col(hi) / bin_size))
    binned = tiles.select(F.col("name").alias("_tile"), *(F.col(c).alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")), F.explode(span("xmin", "xmax")).alias("_bx"), span("ymin", "ymax").alias("_bys"))
    binned = binned.withColumn("_by", F.explode("_bys")).drop("_bys")
    asked = placed.withColumn("_bx", F.floor(F.col("_x") / bin_size)).withColumn("_by", F.floor(F.col("_y") / bin_size))
    met = asked.join(small(binned), ["_bx", "_by"]).where((F.col("_x") >= F.col("_xmin")) & (F.col("_x") < F.col("_xmax")) & (F.col("_y") > F.col("_ymin")) & (F.col("_y") <= F.col("_ymax")))
    return met.select(F.col("_tile").alias("tile"), *cells.columns)


def burn_sides(sides: DataFrame, key: str, res: float = 1.0, x_min: float = 0.0, y_max: float = 0.0) -> DataFrame:
    """(key, row, col) of the cells whose centre is inside polygons given by their sides (key, x, y, x2, y2), even-odd.

    Every side gives a crossing with each row of centres it passes; the crossings of a polygon's row are put in order
    and taken by pairs, so a polygon of any size is dealt to tasks by rows."""
    row_of = lambda y: (F.lit(y_max) - y) / res - 0.5
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    passed = sides.where("y <> y2").select(key, "x", "y", "x2", "y2", F.explode(F.sequence(F.floor(row_of(high)), F.ceil(row_of(low)))).alias("row"))
    at = F.lit(y_max) - (F.col("row") + 0.5) * res
    crossed = passed.where((F.col("y") > at) != (F.col("y2") > at)).select(key, "row", ((F.col("x2") - F.col("x")) * (at - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x")).alias("_x"))
    order = Window.partitionBy(key, "row").orderBy("_x")
    pairs = crossed.select(key, "row", "_x", F.lead("_x").over(order).alias("_end"), F.row_number().over(order).alias("_n")).where("_n % 2 = 1")
    cell = lambda c: F.ceil((F.col(c) - x_min) / res - 0.5).cast("int")
    spans = pairs.select(key, F.col("row").cast("int").alias("row"), cell("_x").alias("a"), cell("_end").alias("b")).where("a < b")
    return spans.select(key, "row", F.explode(F.sequence("a", F.col("b") - 1)).alias("col"))


def burn(polygons: DataFrame, key: str, res: float = 1.0, x_min: float = 0.0, y_max: float = 0.0) -> DataFrame:
    """(key, row, col) of the cells inside each polygon (column rings: array<array<struct<x, y>>>)."""
    ring = polygons.select(key, F.explode("rings").alias("p"))
    after = F.concat(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, 1))
    each = ring.select(key, F.explode(F.zip_with("p", after, lambda a, b: F.struct(a["x"].cast("double").alias("x"), a["y"].cast("double").alias("y"), b["x"].cast("double").alias("x2"), b["y"].cast("double").alias("y2")))).alias("s"))
    return burn_sides(each.select(key, "s.x", "s.y", "s.x2", "s.y2"), key, res, x_min, y_max)


def mask_by_polygon(cells: DataFrame, polygons: DataFrame, bands: list[str], key: str = "name", res: float = 1.0, x_min: float = 0.0, y_max: float = 0.0) -> DataFrame:
    """NULL bands where the centre is in none of the polygons (columns key, rings)."""
    inside = burn(polygons, key, res, x_min, y_max).select("row", "col").distinct().withColumn("_in", F.lit(True))
    return cells.join(inside, ["row", "col"], "left").select(*(F.when(F.col("_in"), F.col(c)).alias(c) if c in bands else F.col(c) for c in cells.columns))


def mask_by_boxes(cells: DataFrame, boxes: DataFrame, bands: list[str], res: float = 1.0, x_min: float = 0.0, y_max: float = 0.0) -> DataFrame:
    """NULL bands outside all boxes."""
    inside = assign_tiles(cells.select("row", "col"), boxes, res, x_min, y_max).select("row", "col").distinct().withColumn("_in", F.lit(True))
    return cells.join(inside, ["row", "col"], "left").select(*(F.when(F.col("_in"), F.col(c)).alias(c) if c in bands else F.col(c) for c in cells.columns))


def mask_by_raster(cells: DataFrame, mask: DataFrame, zone: str, bands: list[str], value: int = 0) -> DataFrame:
    """NULL bands where the mask cell has `value`."""
    joined = cells.join(mask.select("row", "col", F.col(zone).alias("_zone")), ["row", "col"], "left")
    return joined.select(*(F.when(F.col("_zone").isNull() | (F.col("_zone") != value), F.col(c)).alias(c) if c in bands else F.col(c) for c in cells.columns))


#: names of tiles up to which a bit map (2 bytes a name) is sent to the tasks
NAMES = 1 << 20


def match_tile_image(tiles: DataFrame, images: DataFrame) -> DataFrame:
    """(name, path): the first image by path that contains the tile's name literally; NULL if none.

    Paths are entered in an inverted index under all their parts that are as long as some name, so that names meet them by
    equality, whatever the number of either; the lengths of names are few.  Parts whose hash no name has (told by a bit map of
    16 bits for each name, up to NAMES names) are left out before the shuffle.  An empty name is in every path."""
    lengths = [r[0] for r in tiles.select(F.char_length("name").alias("n")).where("n > 0").distinct().collect()]
    starts = lambda n: F.when(F.char_length("path") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("path") - (n - 1), F.lit(1))), lambda i: F.substr(F.col("path"), i, F.lit(n))))
    parts = F.flatten(F.array_compact(F.array(*(starts(n) for n in lengths)))) if lengths else F.expr("cast(array() as array<string>)")
    entered = images.select("path").distinct().select("path", F.explode(F.array_distinct(parts)).alias("name"))
    names = tiles.select("name").distinct()
    n = names.count()
    if n <= NAMES:
        hashed = f"pmod(xxhash64(name), {max(64, 16 * n)}L)"
        word, bit = F.expr(f"shiftright({hashed}, 6)"), F.expr(f"shiftleft(1L, cast({hashed} % 64 as int))")
        bits = names.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
        entered = entered.withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).select("path", "name")
    index = entered.groupBy("name").agg(F.min("path").alias("path"))
    anything = images.agg(F.min("path").alias("_least"))
    found = tiles.select("name").join(index, "name", "left").crossJoin(F.broadcast(anything))
    return found.select("name", F.when(F.col("name") == "", F.col("_least")).otherwise(F.col("path")).alias("path"))


def select_bands(cells: DataFrame, bands: dict[str, str]) -> DataFrame:
    """Picks bands and names them."""
    return cells.select("row", "col", *(F.col(b).alias(n) for b, n in bands.items()))


def resample_bilinear(cells: DataFrame, band: str, target: DataFrame, res: float = 1.0, x_min: float = 0.0, y_max: float = 0.0) -> DataFrame:
    """Value at each target centre (trow, tcol, x, y) from the four source centres around it; NULL if one
    that carries weight is missing.  Every target cell asks for its corners in one equi-join."""
    u, v = (F.col("x") - x_min) / res - 0.5, (F.lit(y_max) - F.col("y")) / res - 0.5
    fu, fv = u - F.floor(u), v - F.floor(v)
    corners = F.array(*(F.struct((F.floor(v) + dr).cast("int").alias("row"), (F.floor(u) + dc).cast("int").alias("col"), ((fv if dr else 1 - fv) * (fu if dc else 1 - fu)).alias("w")) for dr in (0, 1) for dc in (0, 1)))
    asked = target.select("trow", "tcol", F.explode(F.filter(corners, lambda c: c["w"] > 0)).alias("c")).select("trow", "tcol", "c.row", "c.col", "c.w")
    got = asked.join(cells.select("row", "col", F.col(band).cast("double").alias("_v")), ["row", "col"], "left")
    whole = F.count("_v") == F.count("*")
    return got.groupBy("trow", "tcol").agg(F.when(whole, F.sum(F.col("w") * F.col("_v"))).alias(band))


def same_grid(a: DataFrame, b: DataFrame) -> bool:
    """Whether two one-row grid tables agree."""
    keys = ["x_min", "y_max", "res_x", "res_y", "nrows", "ncols", "crs"]
    return a.select(keys).first() == b.select(keys).first()


def require_resolution(grid: DataFrame, res: float = 1.0) -> None:
    g = grid.first()
    if g["res_x"] != res or g["res_y"] != res:
        raise ValueError(f"cells must measure {res}, not {g['res_x']} x {g['res_y']}")


def grid_of(cells: DataFrame, res: float = 1.0, crs: str = "EPSG:2154") -> DataFrame:
    """One-row grid table of a cell table."""
    return cells.agg((F.min("col") * F.lit(res)).alias("x_min"), (-F.min("row") * F.lit(res)).alias("y_max"), (F.max("row") - F.min("row") + 1).alias("nrows"), (F.max("col") - F.min("col") + 1).alias("ncols")).select(
        "x_min", "y_max", F.lit(res).alias("res_x"), F.lit(res).alias("res_y"), "nrows", "ncols", F.lit(crs).alias("crs")
    )


def stack_bands(layers: list[DataFrame]) -> DataFrame:
    """Layers joined cell by cell; a cell that any layer has stays."""
    return reduce(lambda a, b: a.join(b, ["row", "col"], "full_outer"), layers)


def strips(width: int, height: int, count: int = 5, overlap: int = 32, patch: int = 128) -> list[tuple[int, int, int, int]]:
    """(strip, offset, width, height) of column strips in whole patches; the last is moved back inside."""
    wide = (width - overlap * (count + 1)) // (count + 2) // patch * patch
    return [(i, max(0, min(i * (wide - overlap), width - wide)), wide, height // patch * patch) for i in range(count)]


def split_strips(cells: DataFrame, width: int, height: int, count: int = 5, overlap: int = 32, patch: int = 128) -> DataFrame:
    """Cells of each strip, columns counted from the strip's start; shared cells repeat."""
    parts = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("strip", "offset", "wide", "high"), s))) for s in strips(width, height, count, overlap, patch)))
    each = cells.select("*", F.explode(parts).alias("s")).where((F.col("col") >= F.col("s.offset")) & (F.col("col") < F.col("s.offset") + F.col("s.wide")) & (F.col("row") < F.col("s.high")))
    return each.select(F.col("s.strip").alias("strip"), "row", (F.col("col") - F.col("s.offset")).alias("col"), *(c for c in cells.columns if c not in ("row", "col")))


def mosaic_mean(tiles: list[DataFrame], bands: list[str]) -> DataFrame:
    """Tiles laid together; cells that several hold are averaged."""
    every = reduce(DataFrame.unionByName, (t.select(*place(t), *bands) for t in tiles))
    return every.groupBy(*place(every)).agg(*(F.avg(b).alias(b) for b in bands))


def mosaic_extent(tiles: DataFrame, res: float = 1.0) -> DataFrame:
    """Bounds and size of the mosaic of tile boxes."""
    return tiles.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")).withColumns(
        {"ncols": F.ceil((F.col("xmax") - F.col("xmin")) / res).cast("int"), "nrows": F.ceil((F.col("ymax") - F.col("ymin")) / res).cast("int")}
    )


def tile_offsets(tiles: DataFrame, res: float = 1.0, truncate: bool = True) -> DataFrame:
    """Offset of each tile in the mosaic, truncated or rounded half to even."""
    e = small(mosaic_extent(tiles, res).select(F.col("xmin").alias("_x"), F.col("ymax").alias("_y")))
    whole = (lambda c: c.cast("int")) if truncate else (lambda c: F.bround(c, 0).cast("int"))
    return tiles.crossJoin(e).select("name", whole((F.col("_y") - F.col("ymax")) / res).alias("row_off"), whole((F.col("xmin") - F.col("_x")) / res).alias("col_off"))


def complete(cells: DataFrame, bands: list[str]) -> DataFrame:
    """A row for every cell of the bounding grid; missing ones have NULL bands.  Only the extent (one row) is shared."""
    e = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).where("r0 is not null")
    every = e.select("c0", "c1", F.explode(F.sequence("r0", "r1")).alias("row")).select("row", F.explode(F.sequence("c0", "c1")).alias("col"))
    return every.join(cells.select("row", "col", *bands), ["row", "col"], "left")


def first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
