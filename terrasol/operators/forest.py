"""Random forests on cell features: Spark ML's, and one whose bags are known."""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasol.operators.grid import small
from terrasol.operators.ranks import permuted
from terrasol.sources.store import cut

#: bins of a feature in bagged trees
BINS = 32
#: rows of a task that counts for bagged trees, rows it counts at a time, and nodes whose counts travel together
BAG_ROWS, HELD, GROUP = 1 << 20, 1 << 17, 64

def training_table(features: DataFrame, label: str = "label") -> DataFrame:
    """Features and label of the cells that have all of them, without coordinates."""
    names = [c for c in features.columns if c not in ("grid_id", "row", "col", label)]
    return features.select(*names, F.col(label).cast("int").alias("label")).na.drop()


def class_weights(table: DataFrame, label: str = "label") -> DataFrame:
    """Weight 1 / class count beside every row; the classes are few."""
    counts = table.groupBy(label).agg((1.0 / F.count("*")).alias("weight"))
    return table.join(small(counts), label)


def train_forest(table: DataFrame, features: list[str], label: str = "label", trees: int = 30, depth: int = 10, seed: int = 42) -> PipelineModel:
    """Balanced probability forest.  Weights are scaled to a mean of 1; the assembler keeps the feature order."""
    weighed = class_weights(table, label)
    mean = small(weighed.agg(F.avg("weight").alias("_m")))
    scaled = weighed.crossJoin(mean).select(*features, label, (F.col("weight") / F.col("_m")).alias("weight"))
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(scaled)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_features(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def align_features(table: DataFrame, expected: list[str]) -> DataFrame:
    """The table's columns in the model's order; a missing one is an error."""
    missing = [c for c in expected if c not in table.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return table.select(*(c for c in ("row", "col", "label") if c in table.columns and c not in expected), *expected)


def predict_cells(model: PipelineModel, cells: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(row, col, also..., p0, p1 ...): class probabilities, NULL where a feature is missing.  Rows stay in place: missing features
    are filled for the model and its answer is dropped there, so no join is needed."""
    names = model_features(model)
    align_features(cells, names)
    ready = cells.select("row", "col", *names, *(F.col(c).alias(f"_also_{c}") for c in also))
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    filled = ready.select("row", "col", *(f"_also_{c}" for c in also), whole.alias("_whole"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names))
    probs = vector_to_array(F.col("probability"))
    classes = model.stages[-1].numClasses
    return model.transform(filled).select("row", "col", *(F.col(f"_also_{c}").alias(c) for c in also), *(F.when(F.col("_whole"), F.get(probs, F.lit(k))).alias(f"p{k}") for k in range(classes)))


def held_out(key: Column, folds: int = 5) -> Column:
    """A fifth of the rows by hash, the same at any partitioning."""
    return F.pmod(F.xxhash64(key), F.lit(folds)) == 0


def forest_error(model: PipelineModel, table: DataFrame, label: str = "label") -> DataFrame:
    """Brier score and accuracy on held-out rows."""
    p = F.get(vector_to_array(F.col("probability")), F.lit(1))
    return model.transform(table.na.drop()).agg(F.avg(F.pow(p - F.col(label), 2)).alias("brier"), F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def permutation_importance(model: PipelineModel, table: DataFrame, label: str = "label", key: str | None = None, seed: int = 42) -> DataFrame:
    """(feature, importance): accuracy lost when one feature's values are those of a random partner among held-out rows, sorted.

    All features are judged in one pass: every row is repeated once for each feature.  Without a key, rows are named by a hash of
    their values, so equal rows share their place."""
    names = model_features(model)
    rows = table.select(*([key] if key else []), *names, label).na.drop()
    rows = rows if key else rows.withColumn("_key", F.xxhash64(*names, label))
    pairs = permuted(rows, names, key or "_key", seed)
    each = pairs.select("*", F.explode(F.array(F.lit(""), *map(F.lit, names))).alias("feature"))
    swapped = each.select(label, "feature", *(F.when(F.col("feature") == c, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) for c in names))
    hits = model.transform(swapped).groupBy("feature").agg(F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("accuracy"))
    whole = small(hits.where("feature = ''").select(F.col("accuracy").alias("_a")))
    return hits.where("feature <> ''").crossJoin(whole).select("feature", (F.col("_a") - F.col("accuracy")).alias("importance")).orderBy(F.desc("importance"))


@dataclass
class BaggedForest:
    """Trees grown on bags that any row can be asked about.

    Nodes are numbered like a heap (children of i: 2 i + 1 and 2 i + 2); `split` holds the feature of each node (-1: a leaf) and `upto`
    the last bin that goes left, one row per tree; `p` and `answer` the share of class 1 and whether it is the most frequent class there."""

    features: list[str]
    bounds: list[np.ndarray]
    split: np.ndarray
    upto: np.ndarray
    p: np.ndarray
    answer: np.ndarray
    limits: dict[int, list[int]]
    seed: int

    @property
    def trees(self) -> int:
        return len(self.split)


def poisson_limits(rate: float) -> list[int]:
    """Bounds of a 32-bit number that make it a Poisson count: the count is how many of them it reaches."""
    out, total, k = [], 0.0, 0
    while total < 1 - 2.0**-33 and k < rate + 40 * math.sqrt(rate) + 40:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(math.floor(2**32 * min(total, 1.0)))
        k += 1
    return out


def bag_limits(table: DataFrame, label: str = "label") -> dict[int, list[int]]:
    """Bag bounds of each class: rows are drawn at a rate of n / (classes * class count), so that bags are balanced."""
    counts = {r[0]: r[1] for r in table.groupBy(label).count().collect()}  # a row per class
    n = sum(counts.values())
    return {k: poisson_limits(n / (len(counts) * c)) for k, c in counts.items()}


def times_drawn(key: Column, label: Column, tree: int | Column, limits: dict[int, list[int]], seed: int = 42) -> Column:
    """How often a tree's bag holds a row: a hash of seed, tree and key as a Poisson count, the same at any partitioning."""
    text = F.concat_ws(":", F.lit(seed), F.lit(tree) if isinstance(tree, int) else tree.cast("string"), key.cast("string"))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    bounds = F.expr("cast(array() as array<bigint>)")
    for k, some in limits.items():
        bounds = F.when(label == k, F.array(*(F.lit(b).cast("bigint") for b in some))).otherwise(bounds)
    # the hash is an array of one, so that it is made once and not for every bound
    return F.get(F.transform(F.array(u), lambda x: F.size(F.filter(bounds, lambda b: x >= b))), F.lit(0))


def bag_draws(keys: list[str], labels: np.ndarray, trees: int, limits: dict[int, list[int]], seed: int) -> np.ndarray:
    """times_drawn() of many rows, (rows, trees)."""
    u = np.empty((trees, len(keys)), np.int64)
    names = [k.encode() for k in keys]
    for t in range(trees):
        u[t] = np.frombuffer(b"".join([md5(b"%d:%d:%b" % (seed, t, k)).digest()[:4] for k in names]), ">u4")
    out = np.zeros((len(keys), trees), np.int32)
    for k, some in limits.items():
        mine = labels == k
        out[mine] = np.searchsorted(np.array(some), u.T[mine], side="right")
    return out


def _known(table: DataFrame, features: list[str], *also: str) -> DataFrame:
    return table.select(*also, *(F.col(c).cast("double").alias(c) for c in features)).na.drop()


def split_bounds(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Rising bounds of each feature's bins, from all rows: its values where these are few, else quantiles.  A value is in the
    bin of the first bound not below it, or in the last bin."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(c, at, 10_000).alias(f"q{i}") for i, c in enumerate(features)), *(F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(features))).first()
    out = []
    for i, c in enumerate(features):
        # the count is off by a few in a hundred; some more than `bins` are looked at
        values = sorted(r[0] for r in rows.select(c).distinct().limit(bins + 1).collect()) if found[f"n{i}"] <= 2 * bins else []
        few = 0 < len(values) <= bins
        out.append(np.unique(np.array(values[:-1] if few else found[f"q{i}"] or [], float)))
    return out


def _bins(columns: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, x).astype(np.uint8) for x, b in zip(columns, bounds)])


def _fall(bins: np.ndarray, split: np.ndarray, upto: np.ndarray, levels: int) -> np.ndarray:
    """The node of one tree that each row (a column of `bins`) is in, after so many levels at most."""
    at = np.zeros(bins.shape[1], np.int64)
    rows = np.arange(bins.shape[1])
    for _ in range(levels):
        f = split[at]
        if (f < 0).all():
            break
        at = np.where(f < 0, at, 2 * at + 1 + (bins[f, rows] > upto[at]))
    return at


def train_bagged(table: DataFrame, features: list[str], label: str = "label", key: str = "key", trees: int = 30, depth: int = 10, seed: int = 42) -> BaggedForest:
    """A balanced forest whose bags are known: every tree is grown on its own draw of the rows, all trees together, a level at a time.

    Rows with a missing feature or label take no part.  `key` names a row; rows of one key share their draws.  One pass over the rows for
    each level: tasks count the classes of every open node by the bins of its features (the rounded-up square root of their number, drawn
    for each node), counts are added up by tree and node in a shuffle, and the best splits by Gini gain, a row for each node, make the
    next level.  Siblings that answer alike are one leaf."""
    known = cut(_known(table, features, key, label))
    limits = bag_limits(known, label)
    bounds = split_bounds(known, features)
    classes = sorted(limits)
    width, most = len(classes), max((len(b) for b in bounds), default=0) + 1
    n = known.count()
    cores = known.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, n >> 14), -(-n // BAG_ROWS))

    def bag(batches):
        for x in batches:
            y = x.column("_label").to_numpy()
            draws = bag_draws(x.column("_key").to_pylist(), y, trees, limits, seed)
            bins = _bins([x.column(c).to_numpy() for c in features], bounds)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(classes, y).astype(np.int16)), pa.array([r.tobytes() for r in bins.T], pa.binary()), pa.array([r.tobytes() for r in draws], pa.binary())], ["y", "bins", "draws"])

    named = known.select(F.col(key).cast("string").alias("_key"), F.col(label).cast("bigint").alias("_label"), *features)
    rows = cut(named.mapInArrow(bag, "y smallint, bins binary, draws binary").repartition(parts))
    rows = rows.coalesce(parts)

    nodes = (2 << depth) - 1
    split, upto = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes), np.int16)
    stats = np.zeros((trees, nodes, width))
    tried = math.ceil(math.sqrt(len(features)))
    open_ = [np.array([0] if n else [], np.int64) for _ in range(trees)]
    for level in range(depth):
        if not any(map(len, open_)):
            break
        chosen = [np.array([np.random.default_rng([seed, t, i]).permutation(len(features))[:tried] for i in some], np.int64).reshape(-1, tried) for t, some in enumerate(open_)]
        grown = rows.mapInArrow(_counts(open_, chosen, split.copy(), upto.copy(), level, most, width), "tree int, part int, counts binary")
        best = grown.groupBy("tree", "part").applyInArrow(_splits(chosen, most, width), "tree int, place int, feature int, bin int, low array<double>, high array<double>")
        after: list[list[int]] = [[] for _ in range(trees)]
        for r in best.collect():  # a row for each open node
            i = int(open_[r.tree][r.place])
            low, high = np.array(r.low), np.array(r.high)
            stats[r.tree, i] = low + high
            if r.feature >= 0:
                split[r.tree, i], upto[r.tree, i] = r.feature, r.bin
                for child, s in ((2 * i + 1, low), (2 * i + 2, high)):
                    stats[r.tree, child] = s
                    if (s > 0).sum() > 1:
                        after[r.tree].append(child)
        open_ = [np.array(sorted(some), np.int64) for some in after]
    answer = stats.argmax(2)
    for t in range(trees):
        for i in range(nodes // 2 - 1, -1, -1):
            a, b = 2 * i + 1, 2 * i + 2
            if split[t, i] >= 0 and split[t, a] < 0 and split[t, b] < 0 and answer[t, a] == answer[t, b]:
                split[t, i] = -1
    one = classes.index(1) if 1 in classes else None
    total = np.maximum(stats.sum(2), 1)
    p = stats[:, :, one] / total if one is not None else np.zeros_like(total)
    return BaggedForest(features, bounds, split, upto, p, (answer == one) & (stats.sum(2) > 0), limits, seed)


def _counts(open_: list[np.ndarray], chosen: list[np.ndarray], split: np.ndarray, upto: np.ndarray, level: int, most: int, width: int):
    """Counts of each class in each bin of each open node's features, over a task's rows, GROUP nodes of a tree to a row."""
    trees = len(open_)
    tried = next(c.shape[1] for c in chosen)

    def run(batches):
        total = [np.zeros(len(some) * tried * most * width, np.int64) for some in open_]

        def add(held):
            if not held:
                return
            y = np.concatenate([x.column(0).to_numpy() for x in held]).astype(np.int64)
            plain = lambda k, kind: np.frombuffer(b"".join(v for x in held for v in x.column(k).to_pylist()), kind).reshape(len(y), -1).T
            bins, draws = np.ascontiguousarray(plain(1, np.uint8)), np.ascontiguousarray(plain(2, np.int32))
            for t in range(trees):
                if not len(open_[t]):
                    continue
                mine = np.flatnonzero(draws[t])
                own = bins[:, mine]
                at = _fall(own, split[t], upto[t], level)
                place = np.full(split.shape[1], -1)
                place[open_[t]] = np.arange(len(open_[t]))
                at = place[at]
                here = np.flatnonzero(at >= 0)
                at, own, times, cls = at[here], own[:, here], draws[t, mine[here]], y[mine[here]]
                each = np.arange(len(at))
                for j in range(tried):
                    where = ((at * tried + j) * most + own[chosen[t][at, j], each]) * width + cls
                    total[t] += np.bincount(where, times, len(total[t])).astype(np.int64)

        held, size = [], 0
        for x in batches:
            held.append(x)
            size += x.num_rows
            if size >= HELD:
                add(held)
                held, size = [], 0
        add(held)
        step = GROUP * tried * most * width
        for t in range(trees):
            pieces = [total[t][i : i + step].tobytes() for i in range(0, len(total[t]), step)]
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["tree", "part", "counts"])

    return run


def _splits(chosen: list[np.ndarray], most: int, width: int):
    """The best split of each node of a group: the greatest Gini gain, then the first feature drawn, then the least bin; -1 if none gains."""

    def gini(s: np.ndarray) -> np.ndarray:
        """Weighted impurity of counts by class."""
        n = s.sum(-1)
        return n - (s**2).sum(-1) / np.maximum(n, 1)

    def run(data: pa.Table) -> pa.Table:
        t, part = data["tree"][0].as_py(), data["part"][0].as_py()
        tried = chosen[t].shape[1]
        c = sum(np.frombuffer(v, np.int64) for v in data["counts"].to_pylist()).reshape(-1, tried, most, width).astype(float)
        low = c.cumsum(2)
        all_ = low[:, :, -1:, :]
        high = all_ - low
        gain = gini(all_) - gini(low) - gini(high)
        gain[(low.sum(-1) == 0) | (high.sum(-1) == 0)] = 0
        flat = gain.reshape(len(c), -1)
        top = flat.argmax(1)
        j, b = top // most, top % most
        each = np.arange(len(c))
        good = flat[each, top] > 1e-9
        place = part * GROUP + each
        feature = np.where(good, chosen[t][place, j], -1)
        arrays = [pa.array(np.full(len(c), t), pa.int32()), pa.array(place, pa.int32()), pa.array(feature, pa.int32()), pa.array(b, pa.int32()), pa.array(list(low[each, j, b]), pa.list_(pa.float64())), pa.array(list(high[each, j, b]), pa.list_(pa.float64()))]
        return pa.table(dict(zip(["tree", "place", "feature", "bin", "low", "high"], arrays)))

    return run


def _leaves(forest: BaggedForest, bins: np.ndarray) -> list[np.ndarray]:
    levels = int(forest.split.shape[1]).bit_length()
    return [_fall(bins, forest.split[t], forest.upto[t], levels) for t in range(forest.trees)]


def oob_votes(forest: BaggedForest, table: DataFrame, label: str = "label", key: str = "key") -> DataFrame:
    """(key, label, votes, p): mean probability of class 1 over the trees that did not see the row; NULL without any."""
    known = _known(table, forest.features, key, label)
    kinds = ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in (key, label))

    def run(batches):
        for x in batches:
            unseen = bag_draws(x.column("_key").to_pylist(), x.column("_label").to_numpy(), forest.trees, forest.limits, forest.seed) == 0
            at = _leaves(forest, _bins([x.column(c).to_numpy() for c in forest.features], forest.bounds))
            total = np.zeros(x.num_rows)
            for t in range(forest.trees):
                total += np.where(unseen[:, t], forest.p[t][at[t]], 0.0)
            votes = unseen.sum(1)
            p = pa.array(total / np.maximum(votes, 1), mask=votes == 0)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(votes, pa.int64()), p], [key, label, "votes", "p"])

    named = known.select(key, label, F.col(key).cast("string").alias("_key"), F.col(label).cast("bigint").alias("_label"), *forest.features)
    return named.mapInArrow(run, f"{kinds}, votes bigint, p double")


def oob_error(votes: DataFrame, label: str = "label") -> DataFrame:
    """Out-of-bag Brier score and accuracy, over rows with a vote, and the number of these and of all votes."""
    hit = (F.col("p") > 0.5) == (F.col(label) == 1)
    return votes.where("votes > 0").agg(F.avg(F.pow(F.col("p") - F.col(label), F.lit(2))).alias("brier"), F.avg(hit.cast("int")).alias("accuracy"), F.count("*").alias("n"), F.sum("votes").alias("votes"))


def oob_importance(forest: BaggedForest, table: DataFrame, label: str = "label", key: str = "key") -> DataFrame:
    """(feature, importance): for every tree, the accuracy on the rows it did not see less that with one feature's values
    taken from a random partner; the mean over the trees.  One pass, in which each batch of rows is judged once per feature."""
    names = forest.features
    pairs = permuted(_known(table, names, key, label), names, key, forest.seed)

    def run(batches):
        for x in batches:
            y = x.column("_label").to_numpy()
            unseen = bag_draws(x.column("_key").to_pylist(), y, forest.trees, forest.limits, forest.seed) == 0
            own, other = (_bins([x.column(before + c).to_numpy() for c in names], forest.bounds) for before in ("", "_p_"))
            for k in range(-1, len(names)):
                bins = own.copy()
                if k >= 0:
                    bins[k] = other[k]
                at = _leaves(forest, bins)
                hits = [int((unseen[:, t] & (forest.answer[t][at[t]] == (y == 1))).sum()) for t in range(forest.trees)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * forest.trees, pa.int32()), pa.array(range(forest.trees), pa.int32()), pa.array(hits, pa.int64()), pa.array(unseen.sum(0), pa.int64())], ["feature", "tree", "hits", "n"])

    named = pairs.select(F.col(key).cast("string").alias("_key"), F.col(label).cast("bigint").alias("_label"), *names, *(f"_p_{c}" for c in names))
    each = named.mapInArrow(run, "feature int, tree int, hits bigint, n bigint").groupBy("feature", "tree").agg(F.try_divide(F.sum("hits").cast("double"), F.sum("n").cast("double")).alias("a"))
    each = cut(each)  # a row for each feature and tree
    whole = each.where("feature < 0").select("tree", F.col("a").alias("_a"))
    mean = each.where("feature >= 0").join(whole, "tree").groupBy("feature").agg(F.avg(F.col("_a") - F.col("a")).alias("importance"))
    return mean.select(F.get(F.array(*map(F.lit, names)), F.col("feature")).alias("feature"), "importance").orderBy(F.desc("importance"), "feature")
