import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasol.llm import language_model as M
from terrasol.llm.language_model import op5_language_model, score
from tests.conftest import DATA

LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def base(rows, train):
    counts = Counter()
    for (_, t), good in zip(rows, train):
        if good:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(d, len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for d, t in rows for w in [tokens(t)]]


def test_base_counts_and_edges(spark):
    rows = [(i, f"The cat {i % 3} sat on THE mat é{i % 5}") for i in range(60)]
    rows += [(100, None), (101, ""), (None, "the cat"), (3, "the cat"), (102, "zebra " * 30_000)]
    train = [d is not None and d % 4 != 0 for d, _ in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for head in (1 << 18, 4):  # nearly all words in the join
        got = score(frame, F.col("doc_id") % 4 != 0, head=head).collect()
        n, want = base(rows, train)
        key = lambda r: (str(r[0]), r[1], r[2])
        have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
        for a, b in zip(have, sorted(want, key=key), strict=True):
            assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9)
        assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert score(frame.limit(0), F.lit(True)).count() == 0
    assert {r.n_known for r in score(frame, F.lit(False)).collect()} == {0}


def in_class(train, cls, q, least):
    """Weights of pairs and Z by plain loops, over dicts."""
    pairs, total = Counter(), Counter()
    for words in train:
        for before, w in zip(["", *words], words):
            pairs[before, w] += 1
            total[before, cls[w]] += 1
    pairs_of = defaultdict(list)
    for (before, w), n in pairs.items():
        if n >= least:
            pairs_of[before, cls[w]].append((w, n))
    weight, z = {}, defaultdict(lambda: 1.0)
    for (before, c), found in pairs_of.items():
        x = dict.fromkeys((w for w, _ in found), 0.0)
        for _ in range(M.UPDATES):
            norm = 1 + sum(q[w] * (math.exp(x[w]) - 1) for w, _ in found)
            for w, n in found:
                mean = total[before, c] * q[w] * math.exp(x[w]) / norm
                x[w] += min(2, max(-2, (n - mean - x[w] / M.PRIOR) / (max(mean, n) + 1 / M.PRIOR)))
        z[before, c] = 1 + sum(q[w] * (math.exp(x[w]) - 1) for w, _ in found)
        weight |= {(before, w): x[w] for w, _ in found}
    return weight, z


@pytest.mark.parametrize("most", [1 << 21, 24])
def test_score_against_plain_loops(spark, monkeypatch, most):
    """With all pairs, and with the frequent ones alone, where a count of pairs decides which these are."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.6, rng.integers(1, 40)) % 30)) for i in range(80)] + [(90, ""), (91, None), (92, "w1 unseen w2 w2")]
    made, trained = [], M.train_weights
    monkeypatch.setattr(M, "train_weights", lambda *x: made.append(trained(*x)) or made[-1])
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), F.col("doc_id") % 4 != 0, pairs=most).collect()}
    train = [tokens(t) for d, t in rows if d % 4]
    counts = Counter(w for words in train for w in words)
    texts = [(t or "").translate(LOWER).encode() for _, t in rows]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    word, kind, sizes = M.tokens(raw, offsets)
    cls = dict(zip((w for _, t in rows for w in tokens(t)), kind.tolist(), strict=True))
    n_c, v_c = Counter(), Counter()
    for w, n in counts.items():
        n_c[cls[w]] += n
        v_c[cls[w]] += 1
    q = {w: (counts[w] + 1) / (n_c[c] + v_c[c] + 1) for w, c in cls.items()}
    pairs = Counter(p for words in train for p in zip(["", *words], words))
    least = next(k for k in range(1, 10_000) if sum(n >= k for n in pairs.values()) <= most)
    weight, z = in_class(train, cls, q, least)
    assert weight and (least > 1) == (most == 24)
    # a class's words and the event of what is unknown make one, after every word
    for before in {"", *counts}:
        for c in n_c:
            inside = sum(q[w] * math.exp(weight.get((before, w), 0)) for w in counts if cls[w] == c)
            assert math.isclose((inside + 1 / (n_c[c] + v_c[c] + 1)) / z[before, c], 1)
    total = sum(counts.values())
    bias = np.log((np.array([n_c[c] for c in range(M.CLASSES)]) + 1) / (total + M.CLASSES)).astype(np.float32)
    log_p = M.log_softmax(made[0][0], bias, M.context(word, kind, sizes))[np.arange(len(kind)), kind]
    at = 0
    for d, t in rows:
        words, want = tokens(t), 0.0
        for before, w in zip(["", *words], words):
            inner = q[w] * math.exp(weight.get((before, w), 0)) / z[before, cls[w]]
            want += (float(log_p[at]) + math.log(inner)) / math.log(10)
            at += 1
        assert math.isclose(got[d], want, rel_tol=1e-4), d


@pytest.mark.parametrize("most, sent", [(1 << 17, 8), (4, 1 << 21), (4, 0), (0, 8)])
def test_no_pair_is_left_out(spark, monkeypatch, most, sent):
    """Pairs that are not sent to the tasks, and pairs of words without a rank, have the same weights and normalisers."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.6, rng.integers(1, 40)) % 30)) for i in range(80)] + [(90, ""), (91, None), (92, "w1 unseen unseen w2 w2")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scores = lambda **x: {r.doc_id: r.score for r in score(frame, F.col("doc_id") % 4 != 0, **x).collect()}
    want = scores()
    monkeypatch.setattr(M, "PAIR_WORDS", most)
    monkeypatch.setattr(M, "BUCKET_TOKENS", 64)
    got = scores(head=6, sent=sent)
    assert got.keys() == want.keys() and len(want) == len(rows)
    for d, x in want.items():
        assert math.isclose(got[d], x, rel_tol=1e-5), d


def test_model_beats_the_base_on_held_out_texts(spark):
    got = op5_language_model(spark, f"{DATA}/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    # an interpolated bigram reaches -3.676
    assert got.s / got.n > -3.64 and got.b / got.n < -4.06
