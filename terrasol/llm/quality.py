"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few dozen numbers (shares of character classes, word and line
statistics).  The model is one lookup table for each binned feature and one for each of a few feature
pairs: boosting cycles over the features, every step fits a shallow tree on the
histogram of gradients and adds its leaves to the table; pairs are chosen by what their
residuals still hold, then boosted the same way with four-leaf trees.  A text's score is
the sum of the table entries of its bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasol.llm import words as W
from terrasol.llm.common import crc_mod, small_batches, table

#: bound of the labelled sample the model is fitted on
LABELLED = 20_000
BINS = 64
PAIR_BINS = 16
PAIRS = 10
ROUNDS = 120
RATE = 0.1
#: least weight of a leaf and ridge of its value
LEAF, RIDGE = 5.0, 1.0

CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "high": range(128, 256),
    "blank": (9, 11, 12, 13, 32),
    "newline": (10,),
    "stop": (ord("."), ord(","), ord(";"), ord(":"), ord("?")),
    "shout": (ord("!"),),
    "bar": (ord("|"), ord("\\"), ord("/"), ord("<"), ord(">"), ord("_"), ord("=")),
    "symbol": tuple(b"#$%&*@^~`"),
    "bracket": tuple(b"()[]{}\"'"),
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in CLASSES.items()}

FEATURES = [*CLASSES, "log_bytes", "log_words", "word_bytes", "word_spread", "long_words", "short_words", "distinct", "top_share", "repeated", "log_lines", "line_bytes", "same_lines", "stop_per_word", "capital_words", "tail_words"]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over consecutive stretches that begin at `first` (n + 1 bounds)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a slice; a text without bytes has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets).astype(float)
    full = np.maximum(size, 1)
    put = {name: k for k, name in enumerate(FEATURES)}
    counted = {}
    for name, where in _TABLES.items():
        counted[name] = _sums(where[raw], offsets)
        out[:, put[name]] = counted[name] / full
    starts, ends, counts = W.spans(raw, offsets, W.SPACED)
    first = np.concatenate([[0], np.cumsum(counts)])
    many = np.maximum(counts, 1)
    length = (ends - starts).astype(float)
    mean = _sums(length, first) / many
    out[:, put["log_bytes"]] = np.log1p(size)
    out[:, put["log_words"]] = np.log1p(counts)
    out[:, put["word_bytes"]] = mean
    out[:, put["word_spread"]] = np.sqrt(np.maximum(_sums(length * length, first) / many - mean * mean, 0))
    out[:, put["long_words"]] = _sums(length >= 12, first) / many
    out[:, put["short_words"]] = _sums(length <= 2, first) / many
    out[:, put["stop_per_word"]] = counted["stop"] / many
    if len(starts):
        out[:, put["capital_words"]] = _sums(_TABLES["upper"][raw[starts]], first) / many
        tail = raw[ends - 1]
        out[:, put["tail_words"]] = _sums(~(_TABLES["lower"] | _TABLES["upper"] | _TABLES["high"] | _TABLES["stop"])[tail], first) / many
        h = W.hashes(raw, starts, ends)
        doc = np.repeat(np.arange(n), counts)
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])
        at = np.flatnonzero(new)
        runs = np.diff(np.concatenate([at, [len(hs)]]))
        out[:, put["distinct"]] = np.bincount(ds[at], minlength=n) / many
        top = np.zeros(n)
        np.maximum.at(top, ds[at], runs)
        out[:, put["top_share"]] = top / many
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
        out[:, put["repeated"]] = _sums(same, first) / many
    lines = counted["newline"] + (size > 0)
    out[:, put["log_lines"]] = np.log1p(lines)
    out[:, put["line_bytes"]] = np.log1p(size / np.maximum(lines, 1))
    # lines by the hash of all their bytes
    ls, le, lc = W.spans(raw, offsets, ~_TABLES["newline"])
    if len(ls):
        h = W.hashes(raw, ls, le)
        doc = np.repeat(np.arange(n), lc)
        pairs = W.mix(h ^ W.mix(doc.astype(np.uint64)))
        distinct = np.unique(pairs, return_index=True)[1]
        out[:, put["same_lines"]] = 1 - np.bincount(doc[distinct], minlength=n) / np.maximum(lc, 1)
    return out


@dataclass
class Model:
    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            total += t[np.searchsorted(self.edges[f], x[:, f], "right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], "right") for f in {f for p in self.pairs for f in p}}
        for (f, g), t in zip(self.pairs, self.pair_tables):
            total += t[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner bounds of about equally full bins."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of each bin after at most `depth` levels of best splits."""
    value = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
        gain[(left_h < LEAF * 0.05) | (h.sum() - left_h < LEAF * 0.05)] = -1
        k = int(np.argmax(gain))
        if gain[k] > 1e-6:
            value[: k + 1] = _tree(g[: k + 1], h[: k + 1], depth - 1)
            value[k + 1 :] = _tree(g[k + 1 :], h[k + 1 :], depth - 1)
    return value


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best four-leaf tree (one cut on each axis) of a grid, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    parts = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    parts.append((cg[-1, -1] - sum(p[0] for p in parts), ch[-1, -1] - sum(p[1] for p in parts)))
    gain = sum(_gain(*p) for p in parts) - _gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [p[0][i, j] / (p[1][i, j] + RIDGE) for p in parts]
    value = np.empty_like(g)
    value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = leaf
    return value, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Cyclic boosting of the tables on a labelled sample; without both labels the model
    is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(edges=[_edges(c, BINS) if len(y) else np.empty(0) for c in x.T], pair_edges=[_edges(c, PAIR_BINS) if len(y) else np.empty(0) for c in x.T])
    model.intercept = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(y) == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(model.pair_edges, x.T)]
    total = np.full(len(y), model.intercept)

    def gradients():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(bins):
            g, h = gradients()
            size = len(model.tables[f])
            step = RATE * _tree(np.bincount(b, g, size), np.bincount(b, h, size), 2)
            model.tables[f] += step
            total += step[b]
    g, h = gradients()

    def grid(f, k, g, h):
        wide = len(model.pair_edges[k]) + 1
        cell, size = coarse[f] * wide + coarse[k], (len(model.pair_edges[f]) + 1) * wide
        return cell, np.bincount(cell, g, size).reshape(-1, wide), np.bincount(cell, h, size).reshape(-1, wide)

    gains = []
    for f in range(x.shape[1]):
        for k in range(f):
            _, a, b = grid(f, k, g, h)
            gains.append((_grid_tree(a, b)[1], f, k))
    model.pairs = [(f, k) for gain, f, k in sorted(gains, reverse=True)[:PAIRS] if gain > 1]
    model.pair_tables = [np.zeros((len(model.pair_edges[f]) + 1, len(model.pair_edges[k]) + 1)) for f, k in model.pairs]
    for _ in range(rounds // 4):
        for t, (f, k) in enumerate(model.pairs):
            g, h = gradients()
            cell, a, b = grid(f, k, g, h)
            step = RATE * _grid_tree(a, b)[0]
            model.pair_tables[t] += step
            total += step.ravel()[cell]
    return model


def _featured(batches):
    for batch in batches:
        raw, offsets = W.utf8(batch.column(1))
        rows = [features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in W.slices(offsets)]
        x = np.concatenate(rows) if rows else np.empty((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))], ["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, folds: int = 5) -> Model:
    """Fits on at most `bound` labelled documents outside fold 0, taken in the order of a hash of their id
    (so the sample does not depend on partitions).  Only their numbers reach the driver."""
    small_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (crc_mod("_id", folds) != 0))
    chosen = usable.groupBy("_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "quality", "_text")
    # one row for each chosen id, also where an id stands on several documents
    once = texts.groupBy("_id").agg(F.max("quality").alias("quality"), F.min("_text").alias("_text")).select("quality", "_text")
    got = once.mapInArrow(_featured, "quality int, x array<double>").toArrow()
    y = got["quality"].to_numpy().astype(float)
    x = np.array(got["x"].to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # sums do not depend on the order of rows
    x, y = x[order], y[order]
    return fit(x, y)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The input's columns (or those to keep; one called `score` gives way to the result) and `score`: the model's probability of label 1 (null and empty
    texts are scored by their features, which are all zero)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            raw, offsets = W.utf8(batch.column("_scored"))
            rows = [shared.value.score(features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in W.slices(offsets)]
            columns = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(rows) if rows else np.empty(0), pa.float64())], [*batch.schema.names[:-1], "score"])

    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns if c != "score")).alias("_row"), F.col("text").alias("_scored"))
    out = kept.mapInArrow(run, f"_row {kept.schema['_row'].dataType.simpleString()}, score double")
    return out.select("_row.*", "score")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    out = score(docs, model, ["doc_id"])
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
