"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every text becomes a set of word shingles, a MinHash signature and a 128-bit name of
   the set.  Texts with the same set fold into one class before anything is compared.
2. Classes are posted under their coordinate-value pairs.  A pair of classes that is
   similar enough agrees on at least `agree` coordinates, so posts that nobody shares
   are skipped, a class with too few shared posts is skipped whole, and of the rest only
   the rarest ones (the prefix) can be the first that both share.
3. Classes that meet under a prefix post, directly or through others, form a bunch.  A bunch is compared in
   blocks: collisions of the signatures are counted in numpy, pairs above the match threshold are confirmed on
   their full shingle sets.  A block hands on the edges of a spanning forest, never all pairs, and one class for each
   of its trees.  These meet each other next, and only what is then still apart meets across blocks: a
   large group of near copies is joined without its blocks meeting one another.
4. The components of those edges are the groups.  An id on several rows joins their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasol.llm import words as W
from terrasol.llm.common import BLOCK, bit_map, components, cut, deal, forest_root, in_map, small_batches, table

WIDTH = 5
COORDINATES = 128
_seeds = np.random.default_rng(8)
FACTOR = _seeds.integers(1, 2**63, 1024, dtype=np.uint64) | np.uint64(1)
OFFSET = _seeds.integers(0, 2**63, 1024, dtype=np.uint64)


def agreeing(similarity: float, coordinates: int) -> int:
    """Least number of equal coordinates of a similar pair: five deviations below the
    mean (a pair right at the threshold is missed about once in a million)."""
    return max(1, int(coordinates * similarity - 5 * (coordinates * similarity * (1 - similarity)) ** 0.5))


def _sets(raw, offsets, width, coordinates):
    """Per text of a slice: sorted distinct shingles, and its signature."""
    low = W.LOWER[raw]
    starts, ends, counts = W.spans(low, offsets, W.SPACED)
    all_, n = W.shingles(W.hashes(low, starts, ends), counts, width)
    first = np.cumsum(n) - n
    filled = np.flatnonzero(n)
    signature = np.zeros((len(n), coordinates), np.uint32)
    if len(all_):
        x = np.empty_like(all_)
        for k in range(coordinates):
            np.multiply(all_, FACTOR[k], out=x)
            np.add(x, OFFSET[k], out=x)
            signature[filled, k] = np.minimum.reduceat(x, first[filled]) >> np.uint64(32)
    return [np.unique(all_[a : a + c]) for a, c in zip(first, n)], signature


def _sign(width: int, coordinates: int):
    def run(batches):
        for batch in batches:
            raw, offsets = W.utf8(batch.column(2))
            n, one, two, signs = [], [], [], []
            for i, j in W.slices(offsets):
                sets, signature = _sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, coordinates)
                for s, g in zip(sets, signature):
                    n.append(len(s))
                    one.append(int(W.mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    two.append(int(W.mix(s ^ W.STEP).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    signs.append(g.tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(signs, pa.binary())], ["_id", "_name", "n_shingles", "set1", "set2", "signature"])

    return run


def _post(coordinates: int, shared=None):
    """(post, node) of every coordinate-value pair, or of those that the bit map holds; a post is coordinate and value in
    one number, mixed."""
    shift = np.arange(coordinates, dtype=np.int64) << 32

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, coordinates)
            nodes = np.repeat(batch.column(0).to_numpy(), coordinates)
            posts = W.mix((signs.astype(np.int64) | shift).ravel().astype(np.uint64)).astype(np.int64)
            if shared is not None:
                hit = in_map(shared.value, posts)
                posts, nodes = posts[hit], nodes[hit]
            yield pa.RecordBatch.from_arrays([pa.array(posts), pa.array(nodes)], ["post", "node"])

    return run


def _unpack(width: int, coordinates: int):
    """Shingles and signature of the classes that take part, from their texts."""

    def run(batches):
        for batch in batches:
            raw, offsets = W.utf8(batch.column(batch.num_columns - 1))
            sets, signs = [], []
            for i, j in W.slices(offsets):
                s, g = _sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, coordinates)
                sets += [x.tobytes() for x in s]
                signs += [x.tobytes() for x in g]
            yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("bunch"), batch.column("side"), batch.column("node"), batch.column("part"), pa.array(sets, pa.binary()), pa.array(signs, pa.binary())], ["task", "bunch", "side", "node", "part", "shingles", "signature"])

    return run


def _links(node, side, part, shingles, signature, agree, similarity):
    """Forest edges among the classes of one bunch (side 0: all pairs of the block;
    sides 1 and 2: pairs across two blocks), and one class for each tree.  Classes of one `part` are joined already."""
    up, edges = list(range(len(node))), []
    first: dict[int, int] = {}
    for i, p in enumerate(part.tolist()):
        up[i] = first.setdefault(p, i)
    size = np.array([len(s) for s in shingles])
    across = side.max() > 0
    columns = np.flatnonzero(side == 2) if across else np.arange(len(node))
    for i in np.flatnonzero(side == 1) if across else range(len(node)):
        others = columns if across else columns[i + 1 :]
        near = (size[others] >= similarity * size[i] - 1e-9) & (size[i] >= similarity * size[others] - 1e-9) & (part[others] != part[i])
        others = others[near]
        if not len(others):
            continue
        equal = np.count_nonzero(signature[others] == signature[i], axis=1)
        best = np.argsort(-equal, kind="stable")
        for j in others[best[: np.count_nonzero(equal >= agree)]]:
            a, b = forest_root(up, int(i)), forest_root(up, int(j))
            if a == b:
                continue
            both = len(np.intersect1d(shingles[i], shingles[j], assume_unique=True))
            if both * 100 >= round(similarity * 100) * (size[i] + size[j] - both):
                up[a] = b
                edges.append((int(node[i]), int(node[j])))
    return edges, [int(node[i]) for i in sorted({forest_root(up, i) for i in range(len(node))})]


def _compare(agree: int, coordinates: int, similarity: float):
    """Edges (a, b) of a task's bunches or blocks; a tree's class stands as (a, a)."""

    def run(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        bunch, part = data["bunch"].to_numpy(), data["part"].to_numpy()
        node, side = data["node"].to_numpy(), data["side"].to_numpy()
        shingles = [np.frombuffer(s.as_buffer(), np.uint64) for s in data["shingles"].chunk(0)] if len(node) else []
        signature = np.frombuffer(b"".join(s.as_py() for s in data["signature"].chunk(0)), np.uint32).reshape(-1, coordinates) if len(node) else None
        found: list[tuple[int, int, int]] = []
        order = np.lexsort((node, bunch))
        cuts = np.flatnonzero(np.diff(bunch[order])) + 1
        for rows in np.split(order, cuts):
            edges, trees = _links(node[rows], side[rows], part[rows], [shingles[r] for r in rows], signature[rows], agree, similarity)
            own = int(bunch[rows[0]])
            found += [(own, a, b) for a, b in edges]
            found += [(own, a, a) for a in trees]
        bunches, a, b = zip(*found) if found else ((), (), ())
        return pa.table({"bunch": pa.array(bunches, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _apart(members: DataFrame, block: int) -> DataFrame:
    """Deals bunches of which some parts are still apart (bunch, node, part): (task, bunch, side, node, part).

    A part of more than `block` classes has blocks of its own, smaller parts share blocks; every two blocks of a bunch are
    a task, and a block of smaller parts is one within itself.  Two blocks of one part never meet.
    """
    sizes = members.groupBy("bunch", "part").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("alone", F.col("n") > block)
    shared = sizes.where("not alone").groupBy("bunch").agg(F.ceil(F.sum("n") / block).cast("bigint").alias("groups"))
    sizes = cut(sizes.join(shared, "bunch", "left"))
    own = F.when(F.col("alone"), F.xxhash64("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block).cast("bigint")))).otherwise(F.pmod(F.xxhash64("part"), F.col("groups")))
    placed = cut(members.join(sizes, ["bunch", "part"]).select("bunch", "node", "part", "alone", own.alias("own")))
    blocks = cut(placed.groupBy("bunch", "own").agg(F.max(F.when(F.col("alone"), F.col("part"))).alias("pure")))
    met = placed.join(blocks.select("bunch", F.col("own").alias("other"), F.col("pure").alias("other_pure")), "bunch")
    met = met.where("(own <> other and not (alone and part <=> other_pure)) or (own = other and not alone)")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    task = F.xxhash64("bunch", F.least("own", "other"), F.greatest("own", "other"))
    return met.select(task.alias("task"), "bunch", side.cast("int").alias("side"), "node", "part")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = WIDTH, coordinates: int = COORDINATES, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_shingles, component (smallest id of its group, itself
    included) and kept (it is that smallest one).

    Texts that are null or have no words have no shingles and link with nothing, nor do
    rows with a null id (component null, kept).  Rows with the same id are one document: their sets are joined, and
    it is kept on each.  An empty table gives an empty result; other columns are
    not looked at.  Shingles are compared as 64-bit hashes, sets named by 128 bits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    agree = agreeing(similarity, coordinates)
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text_col).alias("_name"), F.col(text_col).alias("_text"))
    signed = cut(texts.mapInArrow(_sign(width, coordinates), "_id bigint, _name bigint, n_shingles bigint, set1 bigint, set2 bigint, signature binary"))
    filled = signed.where("n_shingles > 0 and _id is not null")
    classes = cut(filled.groupBy("set1", "set2").agg(F.min(F.struct("_id", "_name")).alias("owner"), F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()))

    # posts that several classes share, rarest first
    posts = classes.select("node", "signature").mapInArrow(_post(coordinates), "post bigint, node bigint")
    shared = cut(posts.groupBy("post").agg(F.count("*").alias("n")).where("n > 1"))
    bits = spark.sparkContext.broadcast(bit_map(shared, "post"))
    posted = classes.select("node", "signature").mapInArrow(_post(coordinates, bits), "post bigint, node bigint").join(shared, "post")
    ranked = posted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "post"))).alias("p")).where(F.size("p") >= agree)
    prefix = cut(ranked.select("node", F.explode(F.slice("p", F.lit(1), F.size("p") - agree + 1)).alias("p")).select("node", "p.post"))
    hubs = cut(prefix.groupBy("post").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last"))
    stars = prefix.join(hubs, "post").where("node <> hub").select("hub", "node")
    bunches = cut(components(stars, "hub", "node").withColumnRenamed("component", "bunch"))

    owners = classes.select("node", "owner.*").join(bunches.select("node"), "node")
    taking = cut(texts.join(owners, ["_id", "_name"]).groupBy("node").agg(F.min("_text").alias("_text")))

    def compared(dealt: DataFrame) -> DataFrame:
        sent = dealt.join(taking, "node").select("task", "bunch", "side", "node", "part", "_text")
        sent = sent.mapInArrow(_unpack(width, coordinates), "task bigint, bunch bigint, side int, node bigint, part bigint, shingles binary, signature binary")
        return cut(sent.groupBy("task").applyInArrow(_compare(agree, coordinates, similarity), "bunch bigint, a bigint, b bigint"))

    edges = compared(deal(bunches, block, alone=True).withColumn("part", F.col("node")))
    # of the bunches of several blocks: the trees' classes meet, then what is still apart
    large = cut(bunches.groupBy("bunch").agg(F.count("*").alias("n")).where(F.col("n") > block).select("bunch"))
    trees = cut(edges.where("a = b").join(large, "bunch").select("bunch", F.col("a").alias("node")))
    edges = edges.where("a < b or a > b")
    if not trees.isEmpty():
        edges = edges.unionByName(compared(deal(trees, block, alone=True).withColumn("part", F.col("node"))).where("a <> b"))
        parts = components(edges)
        members = cut(bunches.join(large, "bunch").join(parts, "node", "left").select("bunch", "node", F.coalesce("component", "node").alias("part")))
        split = cut(members.groupBy("bunch").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("bunch"))
        if not split.isEmpty():
            edges = edges.unionByName(compared(_apart(cut(members.join(split, "bunch")), block)).where("a <> b"))
    # an id on rows of different sets joins these
    sets = F.struct("set1", "set2")
    several = cut(filled.groupBy("_id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).where("low < high").select("_id"))
    of_id = filled.join(several, "_id").select("_id", "set1", "set2").join(classes.select("set1", "set2", "node"), ["set1", "set2"])
    if not several.isEmpty():
        least = of_id.groupBy("_id").agg(F.min("node").alias("a"))
        edges = edges.select("a", "b").unionByName(of_id.join(least, "_id").select("a", F.col("node").alias("b")))
    found = components(edges)

    joined = cut(classes.select("set1", "set2", "node", F.col("owner._id").alias("id")).join(found, "node", "left").select("set1", "set2", "id", F.coalesce("component", "node").alias("group")))
    least = cut(joined.groupBy("group").agg(F.min("id").alias("component")))
    named = cut(joined.join(least, "group").select("set1", "set2", "component"))
    out = signed.select("_id", "n_shingles", "set1", "set2").join(named, ["set1", "set2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("_id"))
    component = F.when(F.col("_id").isNotNull(), component)
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component"), (F.col("_id").eqNullSafe(component)).alias("kept"))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents", "doc_id", "text"), similarity=0.85)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")
