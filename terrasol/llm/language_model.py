"""Language-model scoring with a hashed maximum-entropy model.

P(word | context) = P(class | context) * P(word | class).  The class of a word is a hash
of its ending.  The first factor is a softmax over classes whose weights stand in hashed
rows for n-gram and skip features of the context; it is trained by distributed
gradient updates: in each round every task takes a share of the training texts from the
common weights on, and the weights are averaged by the tokens seen.

The second factor is a softmax inside the class, over all its words and one event for
what is unknown:  P(word | class, before) = q(word) * exp(weight(before, word)) / Z(before, class), where q is the
smoothed share of the word in its class, from counts over all training texts, and every pair of neighbours seen in training has
a weight.  Pairs not seen have none, so Z = 1 + sum of q * (exp(weight) - 1) over the pairs seen, which is exact.  Its sufficient statistics are the
counts of pairs; a word's followers share no weight with those of another word, so the
gradient updates of different words (and classes) run in different tasks and nothing is averaged.

Counts are exact for every word and pair.  The most frequent words and pairs, bounded numbers, are sent to the
tasks; the rest of a text's words meet their counts in a join, and the rest of its pairs their weights, by buckets of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasol.llm import words as W
from terrasol.llm.common import crc_mod, cut, small_batches, table

#: classes of words by their ending, and one for the end of the text
CLASSES = 32
END = CLASSES - 1
#: context class before the first word
BEGIN = CLASSES
#: rows of hashed feature weights
ROWS = 1 << 14
ROUNDS = 3
#: text bytes of a training shard
SHARD_BYTES = 16 << 20
#: weight messages averaged by one task
FAN = 64
STEP = 0.15
BATCH = 4096
#: frequent words sent to the tasks: 16 bytes each
HEAD = 1 << 18
#: weight rows of one message
PART = 256
#: pairs sent to the tasks: those with a count from which on there are at most so many (12 bytes each)
PAIRS = 1 << 21
#: words with a number in pairs, the most frequent ones (128 bytes each in the tasks); others go by their hash
PAIR_WORDS = 1 << 17
#: training tokens for each bucket of pairs, and the most buckets
BUCKET_TOKENS, BUCKETS = 1 << 20, 4096
#: pairs that a task holds before it hands them on
HELD = 1 << 20
#: in place of a word: the normaliser of the group
WHOLE = 1 << 62
#: pairs fitted at a time, about
TOGETHER = 1 << 14
#: variance of the weights' prior, gradient updates of a pair's weight
PRIOR, UPDATES = 6.0, 16

END_WORD = int(W.mix(np.array([0x5EED], np.uint64)).astype(np.int64)[0])


def tokens(raw: np.ndarray, offsets: np.ndarray):
    """Hash and class of every token of a slice (an end after each text), and tokens per text."""
    low = W.LOWER[raw]
    starts, ends, counts = W.spans(low, offsets, W.SPACED)
    h = W.hashes(low, starts, ends)
    tail = np.zeros(len(h), np.uint64)
    for k in range(3):
        at = ends - 1 - k
        tail |= np.where(at >= starts, low[np.maximum(at, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    kind = (W.mix(tail) % np.uint64(END)).astype(np.int64)
    sizes = counts + 1
    places = np.cumsum(sizes) - 1
    word = np.full(int(sizes.sum()), END_WORD, np.int64)
    cls = np.full(len(word), END, np.int64)
    inner = np.ones(len(word), bool)
    inner[places] = False
    word[inner], cls[inner] = h.astype(np.int64), kind
    return word, cls, sizes


def context(word: np.ndarray, cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashed feature rows of every token: the word before, the class before, the two
    classes before (n-gram), and the second and third class back (skip)."""
    n = len(word)
    first = np.cumsum(sizes) - sizes
    depth = np.arange(n) - np.repeat(first, sizes)

    def back(values, k, none):
        out = np.full(n, none, values.dtype)
        out[k:] = values[: n - k]
        out[depth < k] = none
        return out

    c1, c2, c3 = (back(cls, k, BEGIN).astype(np.uint64) for k in (1, 2, 3))
    w1 = back(word, 1, 0).astype(np.uint64)
    fold = lambda x, salt: (W.mix(x + np.uint64(salt << 40)) % np.uint64(ROWS)).astype(np.uint16)
    return np.stack([fold(w1, 1), fold(c1, 2), fold(c1 * 64 + c2, 3), fold(c2 * 64 + c3, 4)])


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[0]] + bias
    for r in rows[1:]:
        z += weights[r]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def log_chosen(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log_softmax() of the given classes alone."""
    z = weights[rows[0]] + bias
    for r in rows[1:]:
        z += weights[r]
    z -= z.max(1, keepdims=True)
    own = z[np.arange(len(cls)), cls]
    return own - np.log(np.exp(z, out=z).sum(1))


def update(weights, square, bias, rows, cls):
    """One gradient step of a batch; steps shrink with the squared gradients a row has had."""
    p = np.exp(log_softmax(weights, bias, rows))
    p[np.arange(len(cls)), cls] -= 1
    for r in rows:
        order = np.argsort(r, kind="stable")
        ranked = r[order]
        at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        g = np.add.reduceat(p[order], at, axis=0)
        u = ranked[at]
        square[u] += (g * g).mean(1)
        weights[u] -= STEP * g / np.sqrt(square[u] + 1e-6)[:, None]


def ranks(word: np.ndarray, head: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each token in the head, whether it is there, and its rank among the words of pairs (-1: none of them)."""
    if not len(head):
        return np.zeros(len(word), np.int64), np.zeros(len(word), bool), np.full(len(word), -1)
    at = np.minimum(np.searchsorted(head, word), len(head) - 1)
    hit = head[at] == word
    return at, hit, np.where(hit, rank[at], -1).astype(np.int64)


def paired(word: np.ndarray, cls: np.ndarray, sizes: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Group (word before and class) and name of the word, of every token's pair.  Words among the `most` ones of pairs go by their
    ranks (`most` as the word before: the text begins), others by their hashes, with the highest bit set: those are negative."""
    first = np.cumsum(sizes) - sizes
    before = np.empty(len(own), np.int64)
    before[1:] = own[:-1]
    before[first] = most
    far = np.empty(len(own), np.int64)
    far[1:] = word[:-1]
    group = np.where(before >= 0, before * CLASSES, (far & ~(CLASSES - 1)) | np.iinfo(np.int64).min) | cls
    return group, np.where(own >= 0, own, word | np.iinfo(np.int64).min)


def pair_hash(group: np.ndarray, name) -> np.ndarray:
    return W.mix(group.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(name, np.int64).view(np.uint64))


def bucket_of(group: np.ndarray, buckets: int) -> np.ndarray:
    return (W.mix(group.view(np.uint64)) % np.uint64(buckets)).astype(np.uint16)


def packed(values: np.ndarray) -> bytes:
    """Compressed by bytes of the same weight."""
    size = values.dtype.itemsize
    raw = values.view(np.uint8).reshape(-1, size).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes, kind) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack(group: np.ndarray, name: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs and their counts, by group."""
    order = np.argsort(group)
    parts = [packed(np.diff(group[order], prepend=0)), packed(name[order]), packed(n[order].astype(np.int64))]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, at = [], 0
    for _ in range(3):
        size = int.from_bytes(blob[at : at + 8], "little")
        parts.append(unpacked(blob[at + 8 : at + 8 + size], np.int64))
        at += 8 + size
    return np.cumsum(parts[0]), parts[1], parts[2]


def added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their counts."""
    group, name, n = (np.concatenate(x) for x in zip(*parts))
    key = pair_hash(group, name)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    at = order[first]
    return group[at], name[at], np.add.reduceat(n[order], first) if len(first) else n


def by_bucket(group: np.ndarray, buckets: int):
    """(bucket, places) of the pairs of each bucket."""
    bucket = bucket_of(group, buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, order[bounds[b] : bounds[b + 1]]


def _train(shared):
    def run(batches):
        weights, bias = (x.copy() for x in shared.value)
        square, seen = np.zeros(ROWS, np.float32), 0
        for batch in batches:
            raw, offsets = W.utf8(batch.column(0))
            for i, j in W.slices(offsets):
                word, cls, sizes = tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = context(word, cls, sizes)
                for a in range(0, len(cls), BATCH):
                    update(weights, square, bias, rows[:, a : a + BATCH], cls[a : a + BATCH])
                seen += len(cls)
        if seen:
            parts = weights.reshape(-1, PART * CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "seen", "w"])

    return run


def _merge(data: pa.Table) -> pa.Table:
    """Weighted mean of one part of the weights."""
    seen = data["seen"].to_numpy()
    total = np.zeros(PART * CLASSES)
    for n, w in zip(seen, data["w"].to_pylist()):
        total += n * np.frombuffer(w, np.float32)
    made = (total / seen.sum()).astype(np.float32).tobytes()
    return pa.table({"part": data["part"].slice(0, 1), "seen": pa.array([int(seen.sum())], pa.int64()), "w": pa.array([made], pa.binary())})


def train_weights(texts: DataFrame, fold: str, bias: np.ndarray, rounds: int = ROUNDS, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Weights after `rounds` rounds, and the bias; round r takes the texts whose `fold` is r, so all are
    used once.  Shards are runs of the input's partitions, so many that each has about `shard_bytes`, whatever the
    cluster's cores.  Their messages are averaged up a tree."""
    spark = texts.sparkSession
    weights = np.zeros((ROWS, CLASSES), np.float32)
    bias = bias.astype(np.float32)
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    width = max(1, int(size) // rounds // shard_bytes)
    out = "part int, seen bigint, w binary"
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((weights, bias))
        sent = texts.where(F.col(fold) == r).select("_text").coalesce(width).mapInArrow(_train(shared), out)
        # averaged up a tree, so no task holds more than about FAN messages
        left = width
        while True:
            salts = -(-left // FAN)
            sent = sent.groupBy("part", F.pmod(F.xxhash64("w"), F.lit(salts)).alias("salt")).applyInArrow(_merge, out)
            if salts == 1:
                break
            left = salts
        for row in sent.collect():
            weights.reshape(-1, PART * CLASSES)[row["part"]] = np.frombuffer(row["w"], np.float32)
        shared.unpersist()
    return weights, bias


def _pairs(shared):
    """(part, w): a task's pairs and their counts by buckets, handed on whenever many are held."""

    def run(batches):
        head, rank, most, buckets = shared.value
        pairs, held = [], 0

        def counted():
            found = [(b, pack(*(x[o] for x in pairs[0]))) for b, o in by_bucket(pairs[0][0], buckets)]
            pairs.clear()
            for i in range(0, len(found), 64):
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found[i : i + 64]], pa.int32()), pa.array([w for _, w in found[i : i + 64]], pa.binary())], ["part", "w"])

        for batch in batches:
            raw, offsets = W.utf8(batch.column(0))
            for i, j in W.slices(offsets):
                word, cls, sizes = tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                group, name = paired(word, cls, sizes, ranks(word, head, rank)[2], most)
                pairs.append((group, name, np.ones(len(group), np.int64)))
                held += len(group)
                if held > HELD:
                    pairs[:] = [added(pairs)]
                    held = len(pairs[0][0])
                    if held > HELD * 3 // 4:
                        yield from counted()
                        held = 0
        if pairs:
            pairs[:] = [added(pairs)]
            yield from counted()

    return run


def _sums(data: pa.Table) -> pa.Table:
    """The pairs of one bucket."""
    return pa.table({"part": data["part"].slice(0, 1), "w": pa.array([pack(*added([unpack(w) for w in data["w"].to_pylist()]))], pa.binary())})


def fit_pairs(q: np.ndarray, n: np.ndarray, group: np.ndarray, total: np.ndarray, prior: float = PRIOR, updates: int = UPDATES) -> tuple[np.ndarray, np.ndarray]:
    """Weights of pairs and log Z of their groups (the word before and the class) by gradient updates of the
    likelihood with a normal prior, each one scaled by the curvature's bound.  q: the word's share in its class; n: the pair's
    count; group: rising; total: tokens of the group.  Some groups at a time, whose arrays stay near the processor."""
    weight, log_z = np.zeros(len(n)), np.zeros(len(total))
    starts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(n))
    bounds = np.unique(starts[np.searchsorted(starts, np.append(np.arange(0, len(n), TOGETHER), len(n)))])
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = group[i:j]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.diff(np.append(at, j - i))
        all_, share, seen, x = np.repeat(total[own[at]], size), q[i:j], n[i:j], np.zeros(j - i)
        for _ in range(updates):
            e = share * np.exp(x)
            mean = all_ * e / np.repeat(1 + np.add.reduceat(e - share, at), size)
            x += np.clip((seen - mean - x / prior) / (np.maximum(mean, seen) + 1 / prior), -2, 2)
        weight[i:j] = x
        log_z[own[at]] = np.log(1 + np.add.reduceat(share * np.exp(x) - share, at))
    return weight, log_z


def sought(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted number among rising keys (some at least), and whether it is there; looked up in order, which is faster."""
    order = np.argsort(wanted)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, wanted[order]), len(keys) - 1)
    return at, keys[at] == wanted


def _steps(batches):
    """(near, step, v, n): pairs of each step of counts, and the least count among these; near: of two words with ranks."""
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            group, name, n = unpack(blob)
            near = (group >= 0) & (name >= 0)
            for kind in (True, False):
                some = n[near == kind]
                step, back, v = np.unique(np.floor(np.log2(some) * 16).astype(np.int64), return_inverse=True, return_counts=True)
                low = np.full(len(step), np.iinfo(np.int64).max)
                np.minimum.at(low, back, some)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(step), pa.bool_()), pa.array(step), pa.array(v.astype(np.int64)), pa.array(low)], ["near", "step", "v", "n"])


def _rare(batches):
    """(part, name) of the words without a rank in each bucket's pairs."""
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            name = unpack(blob)[1]
            name = np.unique(name[name < 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), part, np.int32)), pa.array(name)], ["part", "name"])


def _fitted(blob: bytes, counts_of, q: np.ndarray, spread: np.ndarray, least: int) -> tuple:
    """A bucket's pairs that have a weight (group, name, n, weight), and its groups and their log Z.
    counts_of: counts of the rising names of words without a rank."""
    group, name, n = unpack(blob)
    kinds, back = np.unique(group, return_inverse=True)
    total = np.bincount(back, n, len(kinds))
    share = np.empty(len(n))
    ranked = name >= 0
    share[ranked] = q[name[ranked]]
    names, at = np.unique(name[~ranked], return_inverse=True)
    share[~ranked] = (counts_of(names)[at] + 1) / 10 ** spread[group[~ranked] & (CLASSES - 1)]
    keep = n >= least
    group, name, n, back = group[keep], name[keep], n[keep], back[keep]
    weight, log_z = fit_pairs(share[keep], n, back, total)
    full = np.bincount(back, minlength=len(kinds)) > 0
    return group, name, n, weight, kinds[full], log_z[full]


#: of a bucket: frequent pairs and their weights, log Z of groups after words with ranks, counts of the words without one, number of other pairs
FITTED = "part int, pair binary, pair_x binary, z binary, z_x binary, rare binary, rest bigint"


def _fit(shared):
    def run(counted: pa.Table, rare: pa.Table) -> pa.Table:
        *known, sent = shared.value
        if not len(counted):
            return pa.schema([(k, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for k, t in (f.split() for f in FITTED.split(", "))]).empty_table()
        words, counts = rare["name"].to_numpy(), rare["n"].to_numpy()
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        group, name, n, weight, kinds, log_z = _fitted(counted["w"][0].as_py(), lambda names: counts[np.searchsorted(words, names)], *known)
        near = (group >= 0) & (name >= 0) & (n >= sent)
        own = kinds >= 0
        made = {"pair": group[near] * PAIR_WORDS + name[near], "pair_x": weight[near].astype(np.float32), "z": kinds[own], "z_x": log_z[own].astype(np.float32), "rare": counts}
        return pa.table({"part": counted["part"].slice(0, 1), **{k: pa.array([packed(v)], pa.binary()) for k, v in made.items()}, "rest": pa.array([int((~near).sum())], pa.int64())})

    return run


def threshold(steps: DataFrame, most: int) -> int | None:
    """The count from which on there are at most `most`, of (step, v, n); none: there is no such count."""
    least, held = None, 0
    for r in steps.groupBy("step").agg(F.sum("v").alias("v"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        if held + r["v"] > most:
            break
        held, least = held + r["v"], r["n"]
    return least


def pair_weights(counted: DataFrame, counts: DataFrame, q: np.ndarray, spread: np.ndarray, pairs: int | None, sent: int) -> tuple[DataFrame, tuple, tuple]:
    """Buckets (part, w, rare) of all pairs with the counts of their words, what fits them, and (keys of the frequent pairs, rising, their weights,
    log Z by word before and class, whether there are other pairs).
    q: share of the words of pairs by rank; all pairs have a weight, or those with a count from which on there are at most `pairs`."""
    most = len(q)
    steps = cut(counted.select("w").mapInArrow(_steps, "near boolean, step bigint, v bigint, n bigint").groupBy("near", "step").agg(F.sum("v").alias("v"), F.min("n").alias("n")))
    none = np.iinfo(np.int64).max
    least = 1 if pairs is None else threshold(steps, pairs)
    often = threshold(steps.where("near"), sent)
    known = (q, spread, none if least is None else least, none if often is None else often)
    rare = counted.select("part", "w").mapInArrow(_rare, "part int, name bigint")
    named = counts.select(F.col("word").bitwiseOR(F.lit(-(2**63))).alias("name"), "n")
    met = rare.join(named.hint("merge"), "name").select("part", "name", "n")
    fitted = cut(counted.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(_fit(counted.sparkSession.sparkContext.broadcast(known)), FITTED))
    log_z = np.zeros((most + 1) * CLASSES, np.float32)
    keys, x, rest = [], [], False
    for r in fitted.select("pair", "pair_x", "z", "z_x", "rest").toArrow().to_pylist():
        keys.append(unpacked(r["pair"], np.int64))
        x.append(unpacked(r["pair_x"], np.float32))
        log_z[unpacked(r["z"], np.int64)] = unpacked(r["z_x"], np.float32)
        rest = rest or r["rest"] > 0
    keys, x = np.concatenate([*keys, np.empty(0, np.int64)]), np.concatenate([*x, np.empty(0, np.float32)])
    order = np.argsort(keys)
    return counted.join(fitted.select("part", "rare"), "part"), known, (keys[order], x[order], log_z, rest)


def _count(batches):
    """(word, class, n) of a task's texts, handed on whenever many are held."""
    words, kinds, ns = [], [], []

    def folded():
        w, k, n = np.concatenate(words), np.concatenate(kinds), np.concatenate(ns)
        u, first, back = np.unique(w, return_index=True, return_inverse=True)
        words[:], kinds[:], ns[:] = [u], [k[first]], [np.bincount(back, n).astype(np.int64)]

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(words[0]), pa.array(kinds[0].astype(np.int32)), pa.array(ns[0])], ["word", "cls", "n"])

    held = 0
    for batch in batches:
        raw, offsets = W.utf8(batch.column(0))
        for i, j in W.slices(offsets):
            word, cls, _ = tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            u, first, n = np.unique(word, return_index=True, return_counts=True)
            words.append(u)
            kinds.append(cls[first])
            ns.append(n.astype(np.int64))
            held += len(u)
            if held > 2_000_000:
                folded()
                held = len(words[0])
                if held > 1_500_000:
                    yield rows()
                    words.clear(), kinds.clear(), ns.clear()
                    held = 0
    if words:
        folded()
        yield rows()


#: a text's row, or (`_row` null) pairs of a bucket asked by the texts of a sheet, whose rows are `_row` and the sums of `steps`
SCORED = "n_tokens bigint, model double, known bigint, logs double, words array<bigint>, ns array<int>, part int, sheet bigint, steps binary, group binary, name binary"


def _score(shared):
    def run(batches):
        weights, bias, spread, head, log_c, rank, buckets, pairs, pair_x, log_z, rest = shared.value
        most = len(log_z) // CLASSES - 1
        asked, held = [], 0

        def sheet(ids):
            row, group, name = (np.concatenate(x) for x in zip(*asked))
            asked.clear()
            found = [(b, packed(np.diff(row[o], prepend=row[0])), packed(group[o]), packed(name[o])) for b, o in by_bucket(group, buckets)]
            for i in range(0, len(found), 64):
                part, steps, groups, names = zip(*found[i : i + 64])
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, ids),
                        *(pa.nulls(n, t) for t in (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))),
                        pa.array(part, pa.int32()),
                        pa.array([row[0]] * n, pa.int64()),
                        *(pa.array(x, pa.binary()) for x in (steps, groups, names)),
                    ],
                    ["_row", "_id", *(f.split()[0] for f in SCORED.split(", "))],
                )

        for batch in batches:
            raw, offsets = W.utf8(batch.column(2))
            numbers = batch.column(0).to_numpy()
            n_tokens, model, known, logs, tail_words, tail_ns, tail_sizes = [], [], [], [], [], [], []
            for i, j in W.slices(offsets):
                word, cls, sizes = tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = context(word, cls, sizes)
                gain = np.empty(len(cls))
                for a in range(0, len(cls), BATCH):
                    gain[a : a + BATCH] = log_chosen(weights, bias, rows[:, a : a + BATCH], cls[a : a + BATCH])
                at, hit, own = ranks(word, head, rank)
                group, name = paired(word, cls, sizes, own, most)
                near = np.flatnonzero(group >= 0)
                gain[near] -= log_z[group[near]]
                far = np.ones(len(group), bool)
                if len(pairs):
                    both = near[name[near] >= 0]
                    key = group[both] * PAIR_WORDS + name[both]
                    where, met = sought(pairs, key)
                    gain[both] += np.where(met, pair_x[where], 0)
                    far[both[met]] = False
                gain = gain / np.log(10) - spread[cls]
                first = np.cumsum(sizes) - sizes
                doc = np.repeat(np.arange(len(sizes)), sizes)
                if rest:
                    far = np.flatnonzero(far)
                    asked.append((numbers[i:j][doc[far]], group[far], name[far]))
                    held += len(far)
                n_tokens.append(sizes)
                model.append(np.add.reduceat(gain, first))
                known.append(np.add.reduceat(hit.astype(np.int64), first))
                logs.append(np.add.reduceat(np.where(hit, log_c[at], 0.0) if len(head) else np.zeros(len(word)), first))
                left = np.flatnonzero(~hit)
                order = np.lexsort((word[left], doc[left]))
                w, d = word[left][order], doc[left][order]
                new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])])) if len(w) else np.empty(0, np.int64)
                tail_words.append(w[new])
                tail_ns.append(np.diff(np.append(new, len(w))).astype(np.int32))
                tail_sizes.append(np.bincount(d[new], minlength=len(sizes)))
            join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
            bounds = pa.array(np.concatenate([[0], np.cumsum(join(tail_sizes, np.int64))]), pa.int32())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(join(n_tokens, np.int64), pa.int64()),
                    pa.array(join(model, float), pa.float64()),
                    pa.array(join(known, np.int64), pa.int64()),
                    pa.array(join(logs, float), pa.float64()),
                    pa.ListArray.from_arrays(bounds, pa.array(join(tail_words, np.int64), pa.int64())),
                    pa.ListArray.from_arrays(bounds, pa.array(join(tail_ns, np.int32), pa.int32())),
                    pa.array(numbers % buckets, pa.int32()),
                    *(pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())),
                ],
                ["_row", "_id", *(f.split()[0] for f in SCORED.split(", "))],
            )
            if held > HELD // 2:
                yield from sheet(batch.schema.field(1).type)
                held = 0
        if held:
            yield from sheet(batch.schema.field(1).type)

    return run


def _answer(shared):
    """Rows of texts as they are, and what the pairs asked of a bucket add to the texts of each sheet."""

    def run(both: pa.Table, bucket: pa.Table) -> pa.Table:
        *known, sent = shared.value
        texts = both.filter(both["_row"].is_valid()).drop_columns(["part", "sheet", "steps", "group", "name"])
        asked = both.filter(both["_row"].is_null()).select(["sheet", "steps", "group", "name"]).to_pylist() if len(bucket) else []
        told = {"sheet": [], "steps": [], "x": []}
        if asked:
            counts = unpacked(bucket["rare"][0].as_py(), np.int64)
            group, name, n, weight, kinds, log_z = _fitted(bucket["w"][0].as_py(), lambda names: counts, *known)
            rest, own = (group < 0) | (name < 0) | (n < sent), kinds >= 0
            # after a word without a rank the normaliser is asked for too
            keys = np.concatenate([pair_hash(group[rest], name[rest]), pair_hash(kinds[~own], np.full((~own).sum(), WHOLE))])
            x = np.concatenate([weight[rest], -log_z[~own]])
            order = np.argsort(keys)
            keys, x = keys[order], x[order]
            for r in asked if len(keys) else []:
                row, group, name = np.cumsum(unpacked(r["steps"], np.int64)), unpacked(r["group"], np.int64), unpacked(r["name"], np.int64)
                far = np.flatnonzero(group < 0)
                at, met = sought(keys, np.concatenate([pair_hash(group, name), pair_hash(group[far], np.full(len(far), WHOLE))]))
                found = np.where(met, x[at], 0)
                more = found[: len(row)]
                more[far] += found[len(row) :]
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                told["sheet"].append(r["sheet"])
                told["steps"].append(packed(np.diff(row[first], prepend=0)))
                told["x"].append(packed(np.add.reduceat(more, first).astype(np.float32)))
        kinds = {"sheet": pa.int64(), "steps": pa.binary(), "x": pa.binary()}
        n = len(told["sheet"])
        answers = pa.table({**{f.name: pa.nulls(n, f.type) for f in texts.schema}, **{k: pa.array(told[k], t) for k, t in kinds.items()}})
        for k, t in kinds.items():
            texts = texts.append_column(k, pa.nulls(len(texts), t))
        return pa.concat_tables([texts, answers])

    return run


def _gathered(data: pa.Table) -> pa.Table:
    """(_row, far) of a sheet's texts."""
    row = np.concatenate([np.cumsum(unpacked(s, np.int64)) for s in data["steps"].to_pylist()])
    x = np.concatenate([unpacked(s, np.float32) for s in data["x"].to_pylist()])
    rows, back = np.unique(row, return_inverse=True)
    return pa.table({"_row": pa.array(rows + data["sheet"][0].as_py()), "far": pa.array(np.bincount(back, x, len(rows)))})


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, pairs: int | None = None, sent: int = PAIRS) -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score.

    training: a condition that says which rows the model learns from.  Null texts are empty: one
    token, the end.  Null ids and repeated rows stay rows of their own; without
    training rows every word is unknown; an empty table gives an empty result.  Words are
    named by 64-bit hashes.  All pairs seen in training have a weight; `pairs` asks for a smaller model, of at most so many.  At most
    `head` words and `sent` pairs are sent to the tasks; that changes no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(training, F.lit(False)).alias("_train"))
    kind = rows.schema["_id"].dataType.simpleString()
    learn = rows.where("_train").select("_text", F.pmod(F.xxhash64("_id", F.length("_text")), F.lit(ROUNDS)).alias("_fold"))
    counts = cut(learn.select("_text").mapInArrow(_count, "word bigint, cls int, n bigint").groupBy("word").agg(F.first("cls").alias("cls"), F.sum("n").alias("n")))
    of_class = {r["cls"]: (r["n"], r["v"]) for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    total, distinct = sum(n for n, _ in of_class.values()), sum(v for _, v in of_class.values())
    per_class = np.array([of_class.get(c, (0, 0)) for c in range(CLASSES)], float)
    bias = np.log((per_class[:, 0] + 1) / (total + CLASSES))
    spread = np.log10(per_class.sum(1) + 1)

    # the frequent words: all with a count from which on there are at most `head`
    least = threshold(counts.select(F.floor(F.log2("n") * 16).alias("step"), F.lit(1).alias("v"), "n"), head)
    frequent = counts.where(F.col("n") >= least).select("word", "cls", "n").toArrow() if least is not None else None
    names, kinds, ns = (frequent[c].to_numpy() if frequent is not None else np.empty(0, np.int64) for c in ("word", "cls", "n"))
    order = np.argsort(names)
    names, kinds, ns = names[order], kinds[order], ns[order]
    log_c = np.log10(ns + 1.0)
    # the words of pairs, by falling count
    first = np.lexsort((names, -ns))[:PAIR_WORDS]
    rank = np.full(len(names), -1, np.int32)
    rank[first] = np.arange(len(first))
    buckets = min(BUCKETS, int(total) // BUCKET_TOKENS + 1)
    weights, bias = train_weights(learn, "_fold", bias)
    words = spark.sparkContext.broadcast((names, rank, len(first), buckets))
    counted = cut(learn.select("_text").mapInArrow(_pairs(words), "part int, w binary").groupBy("part").applyInArrow(_sums, "part int, w binary"))
    q = (ns[first] + 1) / 10 ** spread[kinds[first]]
    fitting, known, frequent_pairs = pair_weights(counted, counts, q, spread, pairs, sent)
    shared = spark.sparkContext.broadcast((weights, bias, spread, names, log_c, rank, buckets, *frequent_pairs))

    both = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_text").mapInArrow(_score(shared), f"_row bigint, _id {kind}, {SCORED}")
    texts = f"_row bigint, _id {kind}, {SCORED.split(', part')[0]}"
    told = cut(both.groupBy("part").cogroup(fitting.groupBy("part")).applyInArrow(_answer(spark.sparkContext.broadcast(known)), f"{texts}, sheet bigint, steps binary, x binary"))
    scored = told.where("_row is not null").drop("sheet", "steps", "x")
    told = told.where("sheet is not null").select("sheet", "steps", "x").groupBy("sheet").applyInArrow(_gathered, "_row bigint, far double")
    tail = scored.select("_row", F.explode(F.arrays_zip("words", "ns")).alias("t")).select("_row", F.col("t.words").alias("word"), F.col("t.ns").alias("k"))
    rare = counts.where(F.col("n") < least) if least is not None else counts
    found = tail.join(rare.select("word", "n"), "word").select("_row", (F.col("k") * F.log10(F.col("n") + 1.0)).alias("more"), F.col("k").cast("bigint").alias("found"), F.lit(0.0).alias("far"))
    found = found.unionByName(told.select("_row", F.lit(0.0).alias("more"), F.lit(0).cast("bigint").alias("found"), (F.col("far") / float(np.log(10))).alias("far")))
    met = found.groupBy("_row").agg(F.sum("more").alias("more"), F.sum("found").alias("found"), F.sum("far").alias("far"))
    out = scored.drop("words", "ns").join(met, "_row", "left")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("_id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (logs + F.col("model") + F.coalesce("far", F.lit(0.0))).alias("score"),
    )


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    out = score(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
