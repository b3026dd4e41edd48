"""Whitening of embeddings by a covariance over distinct vectors.

Vectors are taken to whole numbers (x), equal ones are grouped with their count, and the fit list
is each distinct x once, weighted by one or by its count.  Sums are exact integers; the covariance is a
weighted product of centred blocks (numpy, one matrix per task, added up in Spark by matrix row).
Every distinct vector is whitened once and joined back to its rows; vectors that many rows share
are dealt to several tasks by a salt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasol.llm.common import cut, table

#: whole steps of a unit
SCALE = 256
#: a vector with more than this share of the rows is dealt to several tasks; at most so many vectors can be
SHARE = 512
#: components with an eigenvalue below this share of the trace have no direction of their own
LEAST = 1e-12
PART = "dim int, i int, v array<double>"


def whole(vector: str, scale: int = SCALE):
    """floor(scale * c) of every entry, in double precision; null for vectors without use."""
    c = F.col(vector).cast("array<double>")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when(c.isNotNull() & ~bad, F.transform(c, lambda e: F.floor(e * scale).cast("bigint")))


def _blocks(batch, k: int):
    """(dimension, rows, matrix) of the vectors of each dimension in column `k` of a batch."""
    vectors = batch.column(k)
    dims = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    first = vectors.offsets.to_numpy()[:-1] - vectors.offsets.to_numpy()[0]
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        if d:
            yield int(d), rows, flat[first[rows][:, None] + np.arange(d)]


def _sums(batches):
    """(dim, n, sums): weights and weighted sums of a task's vectors, exact."""
    total: dict[int, list] = {}
    for batch in batches:
        weight = batch.column(1).to_numpy()
        for d, rows, x in _blocks(batch, 0):
            n, s = total.get(d, (0, np.zeros(d, np.int64)))
            total[d] = (n + int(weight[rows].sum()), s + weight[rows] @ x)
    if total:
        yield pa.RecordBatch.from_pydict({"dim": pa.array(total, pa.int32()), "n": pa.array([n for n, _ in total.values()], pa.int64()), "s": pa.array([s for _, s in total.values()], pa.list_(pa.int64()))})


def _products(fits):
    """Rows of the weighted product of a task's centred vectors."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column(1).to_numpy()
            for d, rows, x in _blocks(batch, 0):
                n, s = fits.value[d]
                z = _centred(x, n, s)
                total[d] = total.get(d, 0) + z.T @ (z * weight[rows, None])
        for d, m in total.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(d, d, np.int32)), "i": pa.array(np.arange(d, dtype=np.int32)), "v": pa.array(list(m), pa.list_(pa.float64()))})

    return run


def _centred(x, n: int, s) -> np.ndarray:
    """x - s / n: the difference is taken in whole numbers where these hold it."""
    if len(x) and n * (int(np.abs(x).max()) + 1) + int(np.abs(s).max()) < 2**62:
        return (n * x - s) / n
    return x.astype(np.float64) - s.astype(np.float64) / n


def _deviations(x, n: int, s) -> list:
    """Sum of (n x - s)^2 of each vector, exact; null where 64 bits do not hold it."""
    near = ((x.astype(np.float64) * n - s) ** 2).sum(1)
    out: list = [None] * len(x)
    whole_steps = len(x) and n * (int(np.abs(x).max()) + 1) + int(np.abs(s).max()) < 2**62
    for r in np.flatnonzero(near < 2.0**64):
        exact = int(((n * x[r] - s) ** 2).sum()) if whole_steps and near[r] < 2.0**62 else sum((n * a - b) ** 2 for a, b in zip(x[r].tolist(), s.tolist()))
        out[r] = exact if exact < 2**63 else None
    return out


def _whitener(models):
    """Projections of distinct vectors: the first columns stay, deviation and whitened components follow."""

    def run(batches):
        for batch in batches:
            deviation, out = [None] * batch.num_rows, [[]] * batch.num_rows
            for d, rows, x in _blocks(batch, 4):
                n, s, values, axes = models.value[d]
                y = _centred(x, n, s) @ axes / np.sqrt(values)
                for r, dev, w in zip(rows, _deviations(x, n, s), y.tolist()):
                    deviation[r], out[r] = dev, w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deviation, pa.int64()), pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "deviation", "w"])

    return run


def _axes(v: np.ndarray, components: int):
    """Leading eigenvalues and unit eigenvectors of a covariance; the largest entry of a vector is positive."""
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    keep = values > LEAST * max(np.trace(v), 0)
    values, axes = values[keep], axes[:, keep]
    return values, axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0) < 0, -1.0, 1.0)


def fit(vectors: DataFrame, components: int = 4) -> dict[int, dict]:
    """Model of each dimension: n, sums, eigenvalues, axes and trace of the weighted covariance of
    `vectors` (x array<bigint>, weight bigint).

    What comes to the driver is a matrix per dimension, however many vectors there are.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("x", "weight")
    parts = vectors.mapInArrow(_sums, "dim int, n bigint, s array<bigint>")
    sums = parts.select("dim", "n", F.posexplode("s").alias("i", "s")).groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    fits: dict[int, tuple] = {}
    for r in sums:
        fits.setdefault(r.dim, (r.n, np.zeros(r.dim, np.int64)))[1][r.i] = r.s
    rows = vectors.mapInArrow(_products(spark.sparkContext.broadcast(fits)), PART)
    cells = rows.select("dim", "i", F.posexplode("v").alias("j", "v")).groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    dim, i, j, v = (cells[c].to_numpy() for c in ("dim", "i", "j", "v"))
    models = {}
    for d, (n, s) in fits.items():
        cov, mine = np.zeros((d, d)), dim == d
        cov[i[mine], j[mine]] = v[mine] / n
        values, axes = _axes(cov, components)
        models[d] = {"n": n, "sums": s, "values": values, "axes": axes, "trace": float(np.trace(cov))}
    return models


def _identity_error(white: DataFrame):
    """(dim, identity_error): largest entry of the whitened fit list's covariance less the identity, centred before multiplying."""
    long = white.select("dim", "weight", "w", F.posexplode("w").alias("i", "v"))
    means = long.groupBy("dim", "i").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("m"))
    mean = means.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms")).select("dim", F.transform("ms", lambda e: e["m"]).alias("ms"))
    centred = white.join(F.broadcast(mean), "dim").select("dim", "weight", F.zip_with("w", "ms", lambda a, b: a - b).alias("z"))
    pairs = centred.select("dim", "weight", "z", F.posexplode("z").alias("i", "a")).select("dim", "weight", "i", "a", F.posexplode("z").alias("j", "b")).where("i <= j")
    cov = pairs.groupBy("dim", "i", "j").agg((F.sum(F.col("a") * F.col("b") * F.col("weight")) / F.sum("weight")).alias("c"))
    return cov.groupBy("dim").agg(F.max(F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("identity_error"))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, weights: str = "one", scale: int = SCALE) -> DataFrame:
    """One row per usable row: id, `x`, `copies` (rows with this x), n, deviation, `whitened` (array over the
    components), `explained` (array) and identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out; a vector without entries has
    no components; null ids and repeated rows stay rows of their own; vectors of different lengths are
    fitted apart, each length over its own fit list. `weights` is "one" (each distinct x once) or "count" (as often as it
    occurs). Ties between eigenvalues leave the axes open within their plane; components without variance (fewer distinct vectors than
    dimensions) are left out. deviation is null where 64 bits do not hold it. Empty tables give an empty result.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights is one or count")
    spark = rows.sparkSession
    named = cut(rows.select(F.col(id_col).alias("_id"), whole(vector_col, scale).alias("x")).where("x is not null"))
    groups = cut(named.groupBy("x").agg(F.count("*").alias("copies")).withColumns({"h": F.xxhash64("x"), "weight": F.col("copies") if weights == "count" else F.lit(1).cast("bigint")}))
    models = fit(groups, components)
    # few vectors can have more than a share of the rows, so the table of their names is small
    most = max(1, named.count() // SHARE)
    common = groups.where(F.col("copies") > most).groupBy("h").agg(F.ceil(F.max("copies") / most).cast("bigint").alias("salts"))
    salted = lambda df: df.join(F.broadcast(common), "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("bigint")))
    sent = spark.sparkContext.broadcast({d: (m["n"], m["sums"], m["values"], m["axes"]) for d, m in models.items()})
    given = "h bigint, salts bigint, copies bigint, weight bigint, x array<bigint>"
    white = cut(salted(groups).select("h", "salts", "copies", "weight", "x").mapInArrow(_whitener(sent), f"{given}, deviation bigint, w array<double>"))
    stats = {r.dim: r.identity_error for r in _identity_error(white.select(F.size("x").alias("dim"), "weight", "w")).collect()}
    known = [(d, m["n"], [float(e) / m["trace"] for e in m["values"]], stats.get(d)) for d, m in models.items()]
    facts = F.broadcast(spark.createDataFrame(known, "dim int, n bigint, explained array<double>, identity_error double"))
    many = white.select("h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), "x", "copies", "deviation", "w")
    dealt = salted(named.withColumn("h", F.xxhash64("x"))).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts"))).drop("salts")
    found = dealt.join(many, ["h", "salt", "x"]).withColumn("dim", F.size("x")).join(facts, "dim", "left")
    return found.select(F.col("_id").alias(id_col), "x", "copies", "n", "deviation", F.col("w").alias("whitened"), "explained", "identity_error")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    each = found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("i")).alias("explained"), "identity_error")
