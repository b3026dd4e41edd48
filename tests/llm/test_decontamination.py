import random
import re

import duckdb
import pyarrow as pa

from terrasol.llm import decontamination as D
from terrasol.llm import words as W
from terrasol.llm.decontamination import OP2_SQL, judged, match, op2_decontamination
from tests.conftest import DATA

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def cases():
    rng = random.Random(2)
    pool = ["the", "of", "zé", "a1", "Q", "lorem", "ipsum", "x"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, items[3][1]), (3, items[4][1]), (93, "!!! ...")]
    docs = []
    for d in range(120):
        w = []
        while len(w) < rng.randrange(1, 120):
            w += words(rng.choice(items)[1])[rng.randrange(4) :] if rng.random() < 0.5 else [rng.choice(pool + ["odd", "New"])]
        docs.append((d, ", ".join(w)))
    docs += [(200, None), (201, ""), (None, docs[0][1]), (5, docs[5][1]), (202, "the " * 40_000)]
    return docs, items


def rows(found):
    return sorted((str(r.doc_id), r.n_words, sum(x.b - x.a for x in r.runs), list(r.items)) for r in found.collect())


def test_matches_every_window(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(a), n, h, i) for a, n, h, i in brute(docs, items))
    assert rows(match(d, b)) == want
    assert rows(match(d, b, block_bytes=300)) == want  # a benchmark of many blocks
    assert match(d.limit(0), b).count() == 0
    assert {r.n_hit for r in judged(match(d, b.limit(0))).collect()} == {0}


def test_longest_match_and_rule(spark):
    text = " ".join(f"w{i}" for i in range(40))
    doc = " ".join(f"o{i}" for i in range(7)) + " " + " ".join(f"w{i}" for i in range(5, 30)) + " end"
    d = spark.createDataFrame([(1, doc), (2, "w1 w2 w3"), (3, " ".join(f"n{i}" for i in range(247)) + " " + " ".join(f"w{i}" for i in range(13)))], "doc_id long, text string")
    got = {r.doc_id: r for r in judged(match(d, spark.createDataFrame([(7, text)], "item_id long, text string"))).collect()}
    r = got[1]
    assert (r.longest, r.longest_item, r.longest_at, r.item_at, r.contaminated) == (25, 7, 7, 5, True)
    assert not got[2].contaminated and got[3].n_hit == 13 and got[3].contaminated


def test_longest_over_all_items_and_positions(spark):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:13] + ["other"])), (2, " ".join(w[:30])), (3, " ".join(["z"] + w[2:30] + ["tail", "more"]))]
    docs = [(1, " ".join(w[:30])), (2, "x " + " ".join(w[:30]) + " tail more"), (3, " ".join(w[:13]))]
    got = {r.doc_id: (r.longest, r.longest_item, r.longest_at, r.item_at) for r in match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (30, 2, 0, 0), 2: (30, 2, 1, 0), 3: (13, 1, 0, 0)}


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    got = op2_decontamination(spark, f"{DATA}/sf0.001")
    names = sorted(got.columns)
    want = duck.sql(f"select {', '.join(names)} from ({OP2_SQL})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want, key=str)


def longest(items, texts):
    raw, offsets = W.utf8(pa.array(texts))
    return [tuple(r[k] for k in ("longest", "longest_at", "longest_item", "item_at")) for r in D._shard(raw, offsets, D.TestSuffixes(items, D.WINDOW))]


def test_ranked_longest_match_equals_the_pairs(monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(14, 60)))) for i in (7, 3, 11, 5)] + [(1, "a a a a"), (2, " ".join("ab" * 12)), (4, " ".join("ab" * 12))]
    texts = [" ".join(rng.choice("aaabbb.") for _ in range(rng.randrange(1, 200))) + " end " + rng.choice(items)[1] for _ in range(80)]
    texts += ["a " * 50, "a a a a", "b", ""]
    pairs = longest(items, texts)
    monkeypatch.setattr(D, "PAIRS", 0)
    assert longest(items, texts) == pairs and len({p[0] for p in pairs}) > 10


def test_a_word_repeated_on_both_sides():
    """40,000 times the same word in item and document: 1.6 billion pairs, none of which is looked at."""
    items = [(1, "the " * 30_000 + "end"), (2, "so " + "the " * 40_000)]
    assert longest(items, ["x " + "the " * 40_000, "the " * 30_000 + "end"]) == [(40_000, 1, 2, 1), (30_001, 0, 1, 0)]
