"""Approximate nearest neighbours by collision counting.

Every shard of vectors keeps one sorted array for each projection onto a random line; lines come in
orthogonal sets, whose counts scatter less than those of independent lines.  A query opens a
window around its own projection in each array, and a vector collides once for every window it lies in.
The first vectors verified by their exact distance are the ones with the most collisions; from then on
the windows' half width is a fixed multiple of the k-th distance found (virtual rehashing: windows are widened or
narrowed in place, and only what enters or leaves them is counted).  Vectors that reach the collision threshold are
verified in growing blocks, most collisions first; a query ends when none is left.

The threshold follows from the lines alone: of vectors in uniformly random directions at the k-th distance
itself, a share of MISSED at most lies below it, of nearer vectors fewer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasol.llm.common import cut, table

PROJECTIONS = 128
#: half width of the windows, in k-th distances
WIDTH = 1.25
#: share of vectors at the k-th distance that may have too few collisions
MISSED = 0.06
#: vectors of a shard
SHARD = 32_768
#: bytes of query vectors sent to the tasks at once
BLOCK_BYTES = 16 << 20


def clean(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable rows by dimension: ids and vectors in double precision.  Out go null ids, null and zero
    vectors and those with null or non-finite components."""
    lengths = np.array(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    good = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid()) & (lengths > 0)
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    starts = np.cumsum(lengths) - lengths
    names = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == d))
        x = flat[starts[rows][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(1) & (x != 0).any(1)
        if fine.any():
            out[int(d)] = (names[rows[fine]].astype(np.int64), x[fine])
    return out


def directions(d: int, projections: int) -> np.ndarray:
    """Lines in orthogonal sets of up to d, scaled so that a difference's mean square is the squared distance."""
    rng = np.random.default_rng(6)
    sets = [np.linalg.qr(rng.standard_normal((d, min(d, projections - at))))[0] for at in range(0, projections, d)]
    return np.concatenate(sets, axis=1) * np.sqrt(d)


def threshold(lines: np.ndarray, width: float = WIDTH, missed: float = MISSED) -> int:
    """Collisions that all but a share `missed` of random directions at unit distance reach."""
    ways = np.random.default_rng(7).standard_normal((4096, len(lines)))
    ways /= np.linalg.norm(ways, axis=1, keepdims=True)
    return int(np.quantile((np.abs(ways @ lines) <= width).sum(1), missed, method="lower"))


class Shard:
    """Sorted projection arrays of some vectors of one dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projections: int = PROJECTIONS, width: float = WIDTH, missed: float = MISSED):
        self.ids, self.x, self.width = ids, x, width
        self.lines = directions(x.shape[1], projections)
        self.collisions = threshold(self.lines, width, missed)
        projected = (x @ self.lines).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, 1)

    def nearest(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and distances of the k nearest found, ties to the smaller id; and how many vectors were verified."""
        n, at = len(self.ids), q @ self.lines
        counts = np.zeros(n, np.int64)
        lo = np.array([np.searchsorted(s, v) for s, v in zip(self.sorted, at)])
        hi = lo.copy()
        least = 1e-9 * (1 + float(np.abs(at).max()))

        def move(half: float):
            """Sets the windows' half width; counts follow what enters and leaves."""
            nonlocal lo, hi
            half = max(half, least)
            new_lo = np.array([np.searchsorted(s, v - half, "left") for s, v in zip(self.sorted, at)])
            new_hi = np.array([np.searchsorted(s, v + half, "right") for s, v in zip(self.sorted, at)])
            for sign, left, right in ((1, (new_lo, lo), (hi, new_hi)), (-1, (lo, new_lo), (new_hi, hi))):
                runs = [o[a:b] for o, a, b in zip(self.order, *left) if a < b] + [o[a:b] for o, a, b in zip(self.order, *right) if a < b]
                if runs:
                    counts[:] += sign * np.bincount(np.concatenate(runs), minlength=n)
            lo, hi = new_lo, new_hi

        open_ = self.ids != query_id
        rows, distances = np.empty(0, np.int64), np.empty(0)
        verified, block = 0, 8 * k

        def verify(new: np.ndarray):
            nonlocal rows, distances, verified
            open_[new] = False
            verified += len(new)
            rows, distances = np.concatenate([rows, new]), np.concatenate([distances, np.sqrt(((self.x[new] - q) ** 2).sum(1))])
            best = np.lexsort((self.ids[rows], distances))[:k]
            rows, distances = rows[best], distances[best]

        def most(new: np.ndarray, size: int) -> np.ndarray:
            return new if len(new) <= size else new[np.argpartition(-counts[new], size)[:size]]

        # first windows of about an eighth of the shard
        near = np.clip(np.stack([lo - n // 16 - k, lo + n // 16 + k]), 0, n - 1)
        move(float(np.median(np.abs(self.sorted[np.arange(len(at)), near] - at))))
        verify(most(np.flatnonzero(open_), block))
        while open_.any():
            move(self.width * distances[-1])
            new = np.flatnonzero(open_ & (counts >= self.collisions))
            if not len(new):
                break
            verify(most(new, block))
            block *= 2
        return self.ids[rows], distances, verified


def _shards(queries, k: int, projections: int, width: float, missed: float):
    def run(batches):
        asked = queries.value
        held: dict[int, list] = {}

        def answer(d: int):
            parts = held.pop(d)
            shard = Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), projections, width, missed)
            out = [(q, *shard.nearest(int(q), v, k)[:2]) for q, v in zip(*asked[d])]
            sizes = [len(i) for _, i, _ in out]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([q for q, _, _ in out], sizes).astype(np.int64)), pa.array(np.concatenate([i for _, i, _ in out])), pa.array(np.concatenate([s for _, _, s in out]))],
                ["query_id", "vec_id", "score"],
            )

        for batch in batches:
            for d, part in clean(batch.column(0), batch.column(1)).items():
                if d in asked:
                    held.setdefault(d, []).append(part)
                    if sum(len(p[0]) for p in held[d]) >= SHARD:
                        yield answer(d)
        for d in list(held):
            yield answer(d)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = PROJECTIONS, width: float = WIDTH, missed: float = MISSED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by Euclidean
    distance in double precision, ties to the smaller id; rows with the query's id are its own.

    Rows with a null id or an unusable vector take no part; vectors meet those of their own
    dimension only; repeated rows are candidates each; empty tables give an empty result.
    Queries go to the shards in blocks of bounded size; where there are several, each one's finds are written
    before the next block is fetched, so only one is held at a time.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    asked = pick(queries)
    size = asked.agg(F.sum(F.size("_v") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    found = None
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        ready = clean(got["_id"].chunk(0), got["_v"].chunk(0)) if got.num_rows else {}
        sent = spark.sparkContext.broadcast(ready)
        part = pick(vectors).mapInArrow(_shards(sent, k, projections, width, missed), "query_id bigint, vec_id bigint, score double")
        if blocks > 1:
            part = cut(part)
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


#: the exact nearest rows; the search is approximate: all of them at sf0.01, 98 in a hundred at sf0.1
OP6_SQL = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND isfinite(list_sum(CAST(embedding AS DOUBLE[]))) AND (list_max(embedding) > 0 OR list_min(embedding) < 0)),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
