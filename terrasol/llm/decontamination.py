"""Benchmark decontamination with suffix arrays of the training shards.

The benchmark is the stated query set: it goes to the tasks in blocks of bounded size.
In a task every slice of documents is a shard.  Its suffix array holds the positions
where a benchmark window can begin at all: all words of the window must be benchmark
words, which leaves out nearly all of an ordinary text and loses no match.  Every test suffix is found by
binary search; the matched positions give the hit words, the items, and the longest
verbatim match with its places in document and item, over all items and positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasol.llm import words as W
from terrasol.llm.common import cut, small_batches, table

#: words of a window; an item of fewer words is one window
WINDOW = 13
#: pairs of a document's positions and items' windows looked at one by one; where there are more, as in repeats, the
#: longest match comes from a full suffix array of the document and the items found
PAIRS = 1 << 18
#: text bytes of the benchmark that go to the tasks at once
BLOCK_BYTES = 4 << 20

RUNS = "array<struct<a:int,b:int>>"
COLUMNS = f"n_words bigint, runs {RUNS}, items array<bigint>, longest int, longest_item bigint, longest_at int, item_at int"
RUN = pa.struct([("a", pa.int32()), ("b", pa.int32())])


class TestSuffixes:
    """Search keys of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        raw, offsets = W.utf8(pa.array([t or "" for _, t in items], pa.string()))
        low = W.LOWER[raw]
        starts, ends, counts = W.spans(low, offsets, W.ALNUM)
        h = W.hashes(low, starts, ends)
        self.words, ids = np.unique(h, return_inverse=True)
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.words >> np.uint64(48)).astype(np.int64)] = True
        ids = ids.astype(np.int64) + 1
        first = np.cumsum(counts) - counts
        at, item, length = [], [], []
        for i in np.flatnonzero(counts):
            c = int(counts[i])
            n = max(1, c - window + 1)
            at.append(first[i] + np.arange(n))
            item.append(np.full(n, i))
            length.append(np.full(n, min(c, window)))
        self.at = np.concatenate(at) if at else np.empty(0, np.int64)
        self.item = np.concatenate(item) if item else np.empty(0, np.int64)
        self.length = np.concatenate(length) if length else np.empty(0, np.int64)
        self.ids, self.item_first = ids, first
        self.item_ids = [i for i, _ in items]
        self.item_end = first + counts
        # one search key for each different window; the items that hold it stay listed
        keys = keys_of(np.concatenate([ids, np.zeros(window, np.int64)]), self.at, self.length, window)
        self.keys, self.key_of = np.unique(keys, return_inverse=True)
        one = np.zeros(len(self.keys), np.int64)
        one[self.key_of] = self.length
        self.key_length = one
        order = np.argsort(self.key_of, kind="stable")
        self.by_key = order
        self.key_at = np.concatenate([[0], np.cumsum(np.bincount(self.key_of, minlength=len(self.keys)))])
        # least window that begins with a word: below that many known words nothing can match
        self.least = np.full(len(self.words) + 1, 1 << 30, np.int64)
        if len(self.at):
            np.minimum.at(self.least, ids[self.at], self.length)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, 0 if no benchmark word."""
        out = np.zeros(len(h), np.int64)
        if len(self.words):
            maybe = np.flatnonzero(self.flags[(h >> np.uint64(48)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
            out[maybe] = np.where(self.words[k] == h[maybe], k + 1, 0)
        return out


def keys_of(ids: np.ndarray, at: np.ndarray, length: np.ndarray, window: int, fill: int = 0) -> np.ndarray:
    """Fixed-width byte keys, ordered like the word numbers, of the words from each
    position; places beyond `length` hold `fill` (ids must be padded by `window`)."""
    m = ids[at[:, None] + np.arange(window)].astype(">u4")
    m[np.arange(window) >= length[:, None]] = fill
    return np.ascontiguousarray(m).view(f"S{4 * window}").ravel()


def _shard(raw: np.ndarray, offsets: np.ndarray, tests: TestSuffixes) -> list[dict]:
    low = W.LOWER[raw]
    starts, ends, counts = W.spans(low, offsets, W.ALNUM)
    out = [{"n_words": int(c), "runs": [], "items": [], "longest": 0, "longest_item": None, "longest_at": None, "item_at": None} for c in counts]
    n = len(starts)
    if not n or not len(tests.keys):
        return out
    ids = tests.numbers(W.hashes(low, starts, ends))
    doc_end = np.repeat(np.cumsum(counts), counts)
    # known words from each position on, within its document
    stops = np.flatnonzero(ids == 0)
    stop = np.append(stops, n)[np.searchsorted(stops, np.arange(n))]
    known = np.minimum(stop, doc_end) - np.arange(n)
    kept = np.flatnonzero((ids > 0) & (known >= tests.least[ids]))
    if not len(kept):
        return out
    padded = np.concatenate([ids, np.zeros(tests.window, np.int64)])
    keys = keys_of(padded, kept, np.minimum(known[kept], tests.window), tests.window)
    order = np.argsort(keys, kind="stable")  # the shard's suffix array
    array, suffixes = kept[order], keys[order]
    lo = np.searchsorted(suffixes, tests.keys, "left")
    full = tests.key_length == tests.window
    hi = np.empty_like(lo)
    hi[full] = np.searchsorted(suffixes, tests.keys[full], "right")
    short = np.flatnonzero(~full)
    if len(short):
        at = np.array([tests.at[tests.by_key[tests.key_at[k]]] for k in short])
        wide = np.concatenate([tests.ids, np.zeros(tests.window, np.int64)])
        hi[short] = np.searchsorted(suffixes, keys_of(wide, at, tests.key_length[short], tests.window, 0xFFFFFFFF), "right")
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return out
    many = hi[found] - lo[found]
    key = np.repeat(found, many)
    pos = array[np.repeat(lo[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    doc = np.searchsorted(np.cumsum(counts), pos, "right")
    first = np.cumsum(counts) - counts
    by = np.lexsort((tests.key_length[key], pos))
    key, pos, doc = key[by], pos[by], doc[by]
    bounds = np.flatnonzero(np.diff(doc)) + 1
    for a, b in zip(np.concatenate([[0], bounds]), np.concatenate([bounds, [len(doc)]])):
        d, begin = doc[a], first[doc[a]]
        p, q = pos[a:b], pos[a:b] + tests.key_length[key[a:b]]
        reach = np.maximum.accumulate(q)
        new = np.concatenate([[True], p[1:] > reach[:-1]])
        ends_ = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(p) - 1]])]
        row = out[d]
        row["runs"] = [{"a": int(x - begin), "b": int(y - begin)} for x, y in zip(p[new], ends_)]
        members = np.concatenate([tests.by_key[tests.key_at[k] : tests.key_at[k + 1]] for k in np.unique(key[a:b])])
        row["items"] = sorted({tests.item_ids[i] for i in np.unique(tests.item[members])})
        row |= _longest(ids, int(begin), int(begin + counts[d]), p, key[a:b], tests)
    return out


def _longest_ranked(ids: np.ndarray, found: np.ndarray, tests: TestSuffixes) -> dict:
    """The longest match of a document's word numbers with the items `found`, from the full suffix array of both: the match
    of a suffix is longest with the item suffix next before or after it, so repeats cost no pairs."""
    parts, origin, n_doc = [ids], [np.full(len(ids) + 1, -1)], len(ids)
    for i in found:
        first, end = int(tests.item_first[i]), int(tests.item_end[i])
        parts.append(tests.ids[first:end])
        origin.append(np.append(np.arange(first, end), -1))
    # a mark of its own ends each part, so no match runs across
    top = int(max(len(tests.words), ids.max(initial=0))) + 1
    text = np.concatenate([np.append(p, top + k) for k, p in enumerate(parts)])
    origin, n = np.concatenate(origin), len(text)
    # ranks of the first 2^k words, until all suffixes differ
    rank = np.unique(text, return_inverse=True)[1]
    ranks = [rank.astype(np.int32)]
    while ranks[-1].max() + 1 < n:
        step = 1 << len(ranks) - 1
        after = np.zeros(n, np.int64)
        after[: n - step] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int32))

    def common(a, b):
        size, a, b = np.zeros(len(a), np.int64), a.copy(), b.copy()
        for k in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
            for v in (size, a, b):
                v[same] += 1 << k
        return size

    order = np.argsort(ranks[-1])
    ours, theirs = np.flatnonzero(order < n_doc), np.flatnonzero(origin[order] >= 0)
    next_ = np.searchsorted(theirs, ours)
    size = np.zeros(n_doc, np.int64)
    for near, there in ((next_ - 1, next_ > 0), (next_, next_ < len(theirs))):
        x = order[ours[there]]
        size[x] = np.maximum(size[x], common(x, order[theirs[near[there]]]))
    at = int(size.argmax())  # the first of the longest
    places = np.flatnonzero(origin >= 0)
    same = origin[places[common(np.full(len(places), at), places) >= size[at]]]
    item = np.searchsorted(tests.item_end[found], same, "right")
    some = min((tests.item_ids[found[i]], int(y - tests.item_first[found[i]])) for i, y in zip(item.tolist(), same.tolist()))
    return {"longest": int(size[at]), "longest_at": at, "longest_item": some[0], "item_at": some[1]}


def _longest(ids, begin, stop, pos, key, tests) -> dict:
    """The longest verbatim match of a document (from `begin` to `stop`) over all items that hold a found window; ties go
    to the first place in the document, then to the least item and its first place."""
    best = None
    held = tests.key_at[key + 1] - tests.key_at[key]
    if held.sum() > PAIRS and (tests.key_length[key] == tests.window).any():
        windows = np.unique(key)
        n = tests.key_at[windows + 1] - tests.key_at[windows]
        w = tests.by_key[np.repeat(tests.key_at[windows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return _longest_ranked(ids[begin:stop], np.unique(tests.item[w]), tests)
    k = 0
    while k < len(pos):  # pairs of a position and an item's window, a bounded number at a time
        upto = max(k + 1, int(np.searchsorted(np.cumsum(held[k:]), PAIRS, "right")) + k)
        n = held[k:upto]
        x = np.repeat(pos[k:upto], n)
        w = tests.by_key[np.repeat(tests.key_at[key[k:upto]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        k = upto
        y, item, size = tests.at[w], tests.item[w], tests.length[w].copy()
        # a match that begins one word earlier holds this one
        whole = size == tests.window
        inner = whole & (x > begin) & (y > tests.item_first[item])
        inner[inner] = ids[x[inner] - 1] == tests.ids[y[inner] - 1]
        x, y, item, size = (v[~inner] for v in (x, y, item, size))
        limit = np.minimum(stop - x, tests.item_end[item] - y)
        live = np.flatnonzero(size < limit)
        while len(live):
            live = live[ids[x[live] + size[live]] == tests.ids[y[live] + size[live]]]
            size[live] += 1
            live = live[size[live] < limit[live]]
        if len(x):
            top = np.flatnonzero(size == size.max())
            some = min((-int(size[i]), int(x[i]) - begin, tests.item_ids[item[i]], int(y[i] - tests.item_first[item[i]])) for i in top)
            best = some if best is None else min(best, some)
    return {"longest": -best[0], "longest_at": best[1], "longest_item": best[2], "item_at": best[3]} if best else {}


def _matcher(shared, window: int):
    def run(batches):
        tests = TestSuffixes(shared.value, window)
        for batch in batches:
            raw, offsets = W.utf8(batch.column(1))
            rows: list[dict] = []
            for i, j in W.slices(offsets):
                rows += _shard(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tests)
            get = lambda k: [r[k] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(get("n_words"), pa.int64()),
                    pa.array(get("runs"), pa.list_(RUN)),
                    pa.array(get("items"), pa.list_(pa.int64())),
                    pa.array(get("longest"), pa.int32()),
                    pa.array(get("longest_item"), pa.int64()),
                    pa.array(get("longest_at"), pa.int32()),
                    pa.array(get("item_at"), pa.int32()),
                ],
                ["_id", "n_words", "runs", "items", "longest", "longest_item", "longest_at", "item_at"],
            )

    return run


def _blocks(bench: DataFrame, block_bytes: int) -> list[tuple]:
    """The benchmark in blocks of about `block_bytes` of text, fetched one by one."""
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    fetch = lambda k: [(r[0], r[1]) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]
    return [(fetch, k) for k in range(n)]


def match(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, n_words, `runs` of hit words (word offsets, end
    exclusive), the `items` with occurring windows (sorted), and the longest verbatim match (of a window or more): its
    words, item, and word offsets in document and item.

    Null or empty texts have no words; null ids and repeated rows stay rows of their own;
    empty tables give empty results or no hits; items with a null id or text hit
    nothing; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    items = bench.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    blocks = _blocks(items, block_bytes)
    if len(blocks) == 1:
        fetch, k = blocks[0]
        out = texts.mapInArrow(_matcher(spark.sparkContext.broadcast(fetch(k)), window), f"_id {kind}, {COLUMNS}")
        return out.withColumnRenamed("_id", id_col)
    # more blocks: each one passes over the texts before the next is fetched, and a row's runs are merged
    numbered = cut(texts.withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered.select(F.struct("_row", F.col("_id").alias("id")).alias("_id"), "_text")
    every = None
    for fetch, k in blocks:
        shared = spark.sparkContext.broadcast(fetch(k))
        got = cut(rows.mapInArrow(_matcher(shared, window), f"_id struct<_row:bigint,id:{kind}>, {COLUMNS}").where("size(items) > 0"))
        shared.unpersist()
        every = got if every is None else every.unionByName(got)
    best = F.min(F.struct((-F.col("longest")).alias("less"), "longest_at", "longest_item", "item_at", "longest"))
    merged = every.groupBy(F.col("_id._row").alias("_row")).agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), best.alias("m"))
    counts = rows.mapInArrow(_matcher(spark.sparkContext.broadcast([]), window), f"_id struct<_row:bigint,id:{kind}>, {COLUMNS}").select(F.col("_id._row").alias("_row"), F.col("_id.id").alias("_id"), "n_words")
    joined = counts.join(merged, "_row", "left")
    runs = F.coalesce(merge_runs(F.col("runs")), F.expr(f"cast(array() as {RUNS})"))
    return joined.select(F.col("_id").alias(id_col), "n_words", runs.alias("runs"), F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"), F.coalesce("m.longest", F.lit(0)).alias("longest"), "m.longest_item", "m.longest_at", "m.item_at")


def merge_runs(runs):
    """Union of word runs that may overlap."""

    def step(acc, r):
        return F.when((F.size(acc) > 0) & (r["a"] <= F.get(acc, F.size(acc) - 1)["b"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"), F.greatest(F.get(acc, F.size(acc) - 1)["b"], r["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(r["a"].alias("a"), r["b"].alias("b")))))

    return F.aggregate(F.array_sort(runs), F.expr(f"cast(array() as {RUNS})"), step)


def judged(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated of `match`'s rows."""
    hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda acc, r: acc + (r["b"] - r["a"]).cast("bigint"))
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named.cast("binary"), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), "longest", "longest_item", "longest_at", "item_at")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return judged(match(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, i AS j, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
bw AS (SELECT DISTINCT item_id, n, win FROM bp),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes WHERE i + n - 1 <= len(w)),
m AS (SELECT k, i, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM m) GROUP BY k),
it AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY k),
pl AS (SELECT k, i, j, n, item_id, i - row_number() OVER (PARTITION BY k, item_id, n, i - j ORDER BY i) AS g FROM dw JOIN bp USING (n, win)),
ru AS (SELECT k, item_id, min(i) AS i, min(j) AS j, count(*) - 1 + n AS size FROM pl GROUP BY k, item_id, n, i - j, g),
lo AS (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY k ORDER BY size DESC, i, item_id, j) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(size, 0) AS INTEGER) AS longest, CAST(lo.item_id AS BIGINT) AS longest_item, CAST(lo.i - 1 AS INTEGER) AS longest_at, CAST(lo.j - 1 AS INTEGER) AS item_at
FROM d LEFT JOIN h USING (k) LEFT JOIN it USING (k) LEFT JOIN lo USING (k)
"""
