"""Simplification of polygons that keeps shared borders shared.

Rings are cut at junctions (corners where other than two sides meet) into arcs.  Corners inside an arc have two
sides, so an arc is named by its least side, whichever way it is walked and however many rings hold it.  Every arc is simplified once, corners
are ranked by weight over the whole layer, and rings are put together from what is left of their arcs."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasol.operators.ranks import ranked
from terrasol.sources.store import cut

#: corners of an arc that one task weighs; a longer arc is cut there, and the cuts stay
PIECE = 1 << 16
#: corners of lines that are weighed many at a time, and about so many corners go to one task
SHORT, TOGETHER = 64, 1 << 17


def following(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the next one of their ring (x2, y2) and the ring's size `m`, by a join on places."""
    sizes = points.groupBy(*keys).agg(F.count("*").alias("m"))
    here = points.join(sizes, keys)
    after = points.select(*keys, F.col("idx").alias("_next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return here.withColumn("_next", ((F.col("idx") + 1) % F.col("m")).cast("int")).join(after.hint("merge"), [*keys, "_next"]).drop("_next")


def edges_of(points: DataFrame) -> DataFrame:
    """(a, b): the different sides of all rings, whichever way they are walked."""
    here, there = F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return following(points.select("patch_id", "ring", "idx", "x", "y"), ["patch_id", "ring"]).select(F.least(here, there).alias("a"), F.greatest(here, there).alias("b")).distinct()


def effective_areas(x: np.ndarray, y: np.ndarray, floor: int = 0) -> np.ndarray:
    """Area at which each corner of an open line goes when the least triangle is cut first; the ends and the
    `floor` heaviest corners stay (infinity)."""
    n = len(x)
    out = np.full(n, np.inf)
    if n < 3:
        return out
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    area = lambda i: abs((x[left[i]] - x[i]) * (y[right[i]] - y[i]) - (x[right[i]] - x[i]) * (y[left[i]] - y[i])) / 2
    now = [np.inf, *(area(i) for i in range(1, n - 1)), np.inf]
    heap = [(a, i) for i, a in enumerate(now[1:-1], 1)]
    heapq.heapify(heap)
    alive, so_far = n - 2, 0.0
    while heap and alive > floor:
        a, i = heapq.heappop(heap)
        if out[i] != np.inf or a != now[i]:
            continue
        so_far = max(so_far, a)
        out[i] = so_far
        alive -= 1
        l, r = left[i], right[i]
        right[l], left[r] = r, l
        for j in (l, r):
            if 0 < j < n - 1:
                now[j] = area(j)
                heapq.heappush(heap, (now[j], j))
    return out


def many_areas(x: np.ndarray, y: np.ndarray, first: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """effective_areas() of many open lines, which begin at the places `first`, each with its floor.  Short lines of the same size and
    floor go together, one corner of each at a time."""
    size = np.diff(np.append(first, len(x)))
    out = np.full(len(x), np.inf)
    for i in np.flatnonzero(size > SHORT):
        own = slice(first[i], first[i] + size[i])
        out[own] = effective_areas(x[own], y[own], floor[i])
    kinds, kind = np.unique(np.stack([size, floor]), axis=1, return_inverse=True)
    kind = kind.ravel()
    for j, (n, least) in enumerate(kinds.T.tolist()):
        if n < 3 or n > SHORT:
            continue
        at = first[kind == j][:, None] + np.arange(n)
        px, py, all_ = x[at], y[at], np.arange(len(at))
        left, right = np.tile(np.arange(-1, n - 1), (len(at), 1)), np.tile(np.arange(1, n + 1), (len(at), 1))
        now, weight = np.full(at.shape, np.inf), np.full(at.shape, np.inf)
        lx, ly, rx, ry, cx, cy = px[:, :-2], py[:, :-2], px[:, 2:], py[:, 2:], px[:, 1:-1], py[:, 1:-1]
        now[:, 1:-1] = np.abs((lx - cx) * (ry - cy) - (rx - cx) * (ly - cy)) / 2
        so_far = np.zeros(len(at))
        for _ in range(n - 2 - least):
            i = now.argmin(1)
            so_far = np.maximum(so_far, now[all_, i])
            weight[all_, i] = so_far
            now[all_, i] = np.inf
            l, r = left[all_, i], right[all_, i]
            right[all_, l], left[all_, r] = r, l
            for k in (l, r):
                inner = np.flatnonzero((k > 0) & (k < n - 1))
                m = k[inner]
                a, b = left[inner, m], right[inner, m]
                mx, my = px[inner, m], py[inner, m]
                now[inner, m] = np.abs((px[inner, a] - mx) * (py[inner, b] - my) - (px[inner, b] - mx) * (py[inner, a] - my)) / 2
        out[at] = weight
    return out


def arcs(points: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(instances, corners): every ring's arcs in order (by..., patch_id, ring, arc, name, forward, rings' arcs `parts`), and the corners
    of each differently named arc once (by..., name, k, x, y, closed ends repeated)."""
    ring = [*by, "patch_id", "ring"]
    sided = cut(following(points.select(*ring, "idx", "x", "y"), ring))
    here, there = F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    side = F.struct(F.least(here, there).alias("a"), F.greatest(here, there).alias("b"))
    edges = sided.select(*by, side.alias("e")).distinct()
    degrees = edges.select(*by, F.explode(F.array("e.a", "e.b")).alias("v")).groupBy(*by, F.col("v.x").alias("x"), F.col("v.y").alias("y")).agg(F.count("*").alias("_degree"))
    flagged = sided.join(degrees, [*by, "x", "y"]).withColumn("_j", (F.col("_degree") != 2).cast("bigint"))
    flagged = flagged.select(*ring, "idx", "m", "x", "y", side.alias("e"), (here < there).alias("_forward"), "_j")
    counted = ranked(flagged, ["idx"], "_before", by=tuple(ring), weight="_j").withColumn("_j", F.col("_j") == 1)
    # corners before a ring's first junction belong to its last arc; n is the ring's number of junctions
    upto = F.col("_before") + F.col("_j").cast("bigint")
    arc = F.when(upto == 0, F.col("n")).otherwise(upto)
    place = F.col("idx") + F.when((upto == 0) & (F.col("n") > 0), F.col("m")).otherwise(0)
    own = counted.select(*ring, arc.alias("arc"), place.cast("bigint").alias("k"), "x", "y", "e", "_forward", F.col("n").alias("parts"))
    own = cut(own)
    # an arc ends with the corner that begins the next one, a closed ring with its own first corner
    ends = counted.where((F.col("n") == 0) & (F.col("idx") == 0) | F.col("_j"))
    before = F.when(F.col("n") == 0, F.lit(0)).when(F.col("_before") == 0, F.col("n")).otherwise(F.col("_before"))
    wraps = (F.col("n") == 0) | (F.col("_before") == 0)
    ends = ends.select(*ring, before.cast("bigint").alias("arc"), (F.col("idx") + F.when(wraps, F.col("m")).otherwise(0)).cast("bigint").alias("k"), "x", "y")
    least = own.groupBy(*ring, "arc").agg(F.min(F.struct("e", F.col("_forward").alias("f"))).alias("s"), F.first("parts").alias("parts"))
    instances = cut(least.select(*ring, "arc", F.col("s.e").alias("name"), F.col("s.f").alias("forward"), F.greatest("parts", F.lit(1)).alias("parts")))
    first = F.min(F.struct("patch_id", "ring", "arc", "forward"))
    chosen = instances.groupBy(*by, "name").agg(first.alias("c"), F.min("parts").alias("least")).select(*by, F.col("c.patch_id").alias("patch_id"), F.col("c.ring").alias("ring"), F.col("c.arc").alias("arc"), "name", F.col("c.forward").alias("_main"), "least")
    corners = own.select(*ring, "arc", "k", "x", "y").unionByName(ends).join(chosen.drop("_main"), [*ring, "arc"]).select(*by, "name", "least", "k", "x", "y")
    named = instances.join(chosen.select(*by, "name", "_main"), [*by, "name"]).withColumn("forward", F.col("forward") == F.col("_main")).drop("_main")
    return named, corners


def simplify(points: DataFrame, keep: float = 0.4, by: str | None = None) -> DataFrame:
    """(by, patch_id, ring, idx, x, y): the share `keep` of a layer's removable corners (of each tile's, with `by`) that carry most area.

    Corners shared by neighbours stay shared, so no gap opens between them; junctions stay; a ring keeps three corners at least, so no shape
    is lost.  Equal weights go by arc and place.  Points are given with idx from 0 on in every ring; weights are in the units of x and y."""
    tile = [by] if by else []
    instances, corners = arcs(points, tile)
    # a ring of one arc needs two corners besides the end, one of two arcs one corner in each
    floor = F.when(F.col("least") == 1, 2).when(F.col("least") == 2, 1).otherwise(0).cast("int")
    # a place inside the arc, and pieces that share their ends
    first = corners.groupBy(*tile, "name").agg(F.min("k").alias("_k0"), F.max("k").alias("_k1"))
    placed = corners.join(first, [*tile, "name"]).withColumns({"k": F.col("k") - F.col("_k0"), "last": F.col("_k1") - F.col("_k0"), "floor": floor}).drop("_k0", "_k1", "least")
    own = F.least(F.floor(F.col("k") / PIECE), F.floor((F.col("last") - 1) / PIECE))
    both = F.when((F.col("k") % PIECE == 0) & (F.col("k") > 0) & (F.col("k") < F.col("last")), F.array(own, own - 1)).otherwise(F.array(own))
    pieces = cut(placed.withColumn("piece", F.explode(both)).withColumn("name", F.struct("name.a.x", "name.a.y", F.col("name.b.x").alias("x2"), F.col("name.b.y").alias("y2"))))
    fields = [*(f"{by} {points.schema[by].dataType.simpleString()}" for _ in tile), "name struct<x:double,y:double,x2:double,y2:double>", "k bigint", "last bigint", "piece bigint", "x double", "y double", "weight double"]

    def run(data: pa.Table) -> pa.Table:
        keys = [data[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in tile]
        keys += [pc.struct_field(data["name"].combine_chunks(), c).to_numpy(zero_copy_only=False) for c in ("x", "y", "x2", "y2")] + [data["piece"].to_numpy()]
        order = np.lexsort([data["k"].to_numpy(), *keys[::-1]])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        first = np.flatnonzero(new)
        data = data.combine_chunks().take(pa.array(order))
        floor = np.where(data["last"].to_numpy()[first] <= PIECE, data["floor"].to_numpy()[first], 0)
        weight = many_areas(data["x"].to_numpy(), data["y"].to_numpy(), first, floor)
        return data.select([*tile, "name", "k", "last", "piece", "x", "y"]).append_column("weight", pa.array(weight))

    # lines are short and many: a task weighs all of a bunch
    bunch = F.pmod(F.xxhash64(*tile, *(F.col(f"name.{c}") + 0.0 for c in ("x", "y", "x2", "y2")), "piece"), F.lit(max(1, -(-pieces.count() // TOGETHER)))).alias("_bunch")
    weighed = cut(pieces.groupBy(bunch).applyInArrow(run, ", ".join(fields)))
    # where two pieces meet the corner is there twice, and stays
    parted = weighed.where(F.col("last") > PIECE).groupBy(*tile, "name", "k").agg(F.first("last").alias("last"), F.first("x").alias("x"), F.first("y").alias("y"), F.max("weight").alias("weight"))
    weighed = weighed.where(F.col("last") <= PIECE).drop("piece").unionByName(parted)
    removable = weighed.where(F.col("weight") < float("inf"))
    placed = ranked(removable, ["weight", "name", "k"], "_place", by=tuple(tile))
    heavy = placed.where(F.col("_place") >= F.floor(F.col("n") * F.lit(1 - keep))).drop("_place", "n")
    left = heavy.unionByName(weighed.where(F.col("weight") == float("inf")))
    name = F.struct("name.a.x", "name.a.y", F.col("name.b.x").alias("x2"), F.col("name.b.y").alias("y2"))
    met = instances.withColumn("name", name).join(left, [*tile, "name"])
    # the end of an arc is the beginning of the next
    met = met.where(F.when(F.col("forward"), F.col("k") < F.col("last")).otherwise(F.col("k") > 0))
    order = met.select(*tile, "patch_id", "ring", "arc", F.when(F.col("forward"), F.col("k")).otherwise(-F.col("k")).alias("_o"), "x", "y")
    out = ranked(order, ["arc", "_o"], "_i", by=(*tile, "patch_id", "ring"))
    return out.select(*tile, "patch_id", "ring", F.col("_i").cast("int").alias("idx"), "x", "y")


def transformed(points: DataFrame, to: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """Points in other coordinates; equal points stay equal."""
    x, y = to(F.col("x"), F.col("y"))
    return points.withColumns({"_x": x, "_y": y}).drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})
