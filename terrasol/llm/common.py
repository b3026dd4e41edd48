"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of an Arrow batch: keeps a batch of ordinary documents at a few MB
BATCH_ROWS = 512
#: whether the shuffle files of a query go when it ends
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Arrow batches, whatever the session's default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, a local one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or f"file://{tempfile.gettempdir()}/terrasol-shared"


def cut(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: the lineage ends at files
    that outlive any executor.  Its shuffle files go when it is written, not when the driver happens to collect
    its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo `modulus`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def bit_map(names: DataFrame, column: str, most: int = 27) -> np.ndarray:
    """Map of the names (64-bit numbers) in a table, sixteen bits for each one, 2^most bits at most (16 MB): a
    name that is there finds its bit set, another one seldom.  Only a filter before an exact join."""
    bits = min(most, max(16, (16 * names.count()).bit_length()))
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = names.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out


def in_map(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = names & (len(bits) * 64 - 1)
    return (bits[place >> 6] >> (place & 63)) & 1 != 0


#: edges whose components one task finds in memory (16 bytes each)
FOREST = 1 << 20


def _forest(batches):
    """(u, v): stars of the components of a task's edges, u the smallest node."""
    us, vs = [], []
    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
    if not us:
        return
    nodes, ends = np.unique(np.concatenate(us + vs), return_inverse=True)
    a, b = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[label[inner]]), pa.array(nodes[inner])], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph given by its edges.

    Tasks of about FOREST edges replace these by the stars of what they join, which is all for a small graph.  A
    larger one goes through alternating large-star and small-star rounds; each one is two shuffles keyed by
    node, and every vertex links to its smallest neighbour only, so a hub with very
    many neighbours adds one row for each of them, never pairs among them.  Every
    round is cut to the shared folder; the least neighbours are a table of their
    own, so that Spark can split the rows of a hub in their join.  Returns (node, component): component is the
    smallest node; nodes without an edge are absent.
    """
    links = cut(edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v"))
    tasks = -(-links.count() // FOREST)
    links = cut(links.coalesce(max(1, tasks)).mapInArrow(_forest, "u bigint, v bigint"))
    before = None
    while tasks > 1:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        # large star: every larger neighbour goes to the smallest one
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest one
        low2 = large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
        joined = large.withColumnRenamed("v", "n").join(low2, "n")
        small = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(low2.select(F.col("m").alias("u"), F.col("n").alias("v")))
        links = cut(small.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def forest_root(up: list[int], i: int) -> int:
    """Root of a union-find tree, halving the path."""
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


#: members of a block; two blocks with all they carry fit a task many times over
BLOCK = 256
#: bunches of up to BLOCK members share a task until it has about so many
TASK = 2048


def deal(bunches: DataFrame, block: int = BLOCK, per_task: int = TASK, alone: bool = False) -> DataFrame:
    """Deals the members of bunches (bunch, node) to tasks: (task, bunch, side, node).

    Small bunches share tasks (side 0).  A large one is cut into blocks; a block is a
    task within itself (side 0), and every two blocks are a task (sides 1 and 2), so no task
    holds more than two blocks of a bunch, however large it is.  With `alone`, blocks do not meet one another.
    """
    sizes = cut(bunches.groupBy("bunch").agg(F.count("*").alias("n")))
    tasks = max(1, -(-bunches.count() // per_task))
    placed = bunches.join(sizes, "bunch").withColumn("blocks", F.ceil(F.col("n") / block).cast("bigint")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.array("own") if alone else F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    dealt = placed.select("bunch", "node", "blocks", "own", F.explode(others).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    large = F.xxhash64("bunch", F.least("own", "other"), F.greatest("own", "other")).bitwiseOR(F.lit(-(2**62)))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bunch"), F.lit(tasks))).otherwise(large)
    return dealt.select(task.alias("task"), "bunch", side.cast("int").alias("side"), "node")
