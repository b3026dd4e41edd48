import math

import numpy as np
import pytest

from terrasol.llm.whitening import op12_whitening, whiten
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, x string, h int, n string"


def brute(rows, weights="one", components=4):
    """(id, component) -> (n, deviation, whitened, explained) by numpy over the list of distinct vectors."""
    good = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in sorted({len(x) for _, x in good if x}):
        mine = [(i, x) for i, x in good if len(x) == d]
        fit = sorted({x for _, x in mine}) if weights == "one" else [x for _, x in mine]
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        z = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
        v = z.T @ z / n
        values, axes = np.linalg.eigh(v)
        for k in range(min(d, components)):
            e, u = values[-1 - k], axes[:, -1 - k]
            if e > 1e-12 * np.trace(v):
                for i, x in mine:
                    y = np.array([(n * a - b) / n for a, b in zip(x, s)])
                    out.append((i, k + 1, n, sum((n * a - b) ** 2 for a, b in zip(x, s)), float(y @ u / math.sqrt(e)), float(e / np.trace(v))))
    return sorted(out, key=lambda r: (repr(r[0]), r[1], r[3], abs(r[4])))


def same(got, want):
    got = sorted(got, key=lambda r: (repr(r[0]), r[1], r[3], abs(r[4])))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for sign_of in {g[1] for g in got}:
        mine = [(g, w) for g, w in zip(got, want) if g[1] == sign_of]
        big, ref = max(mine, key=lambda p: abs(p[1][4]))
        sign = math.copysign(1, big[4] * ref[4])
        assert all(abs(g[4] - sign * w[4]) < 1e-9 * (1 + abs(w[4])) and abs(g[5] / w[5] - 1) < 1e-9 for g, w in mine)
    assert all(g[6] < 1e-9 for g in got)


def frame(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, "q", 1, "m") for i, v in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


RNG = np.random.default_rng(5)
PLAIN = [(i, [float(c) for c in v]) for i, v in enumerate(RNG.normal(0, 0.3, (300, 8)) * np.arange(1, 9))]
HOT = [(1000 + i, PLAIN[3][1]) for i in range(300)] + [(2000 + i, [0.0] * 8) for i in range(40)]
BAD = [(1, None), (2, [1.0, None] + [0.0] * 6), (3, [float("nan")] * 8), (4, [float("inf")] + [0.0] * 7), (5, []), (None, PLAIN[7][1]), (PLAIN[8][0], PLAIN[8][1])]


def test_query_equals_numpy(spark, tmp_path):
    rows = PLAIN + HOT + BAD
    got = [tuple(r) for r in op12_whitening(spark, frame(spark, tmp_path, rows)).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()]
    assert got[0][2] == 301
    same(got, brute(rows))


def test_weights_by_count(spark):
    rows = PLAIN[:50] + HOT
    found = whiten(spark.createDataFrame([(i, v, "q", 1, "m") for i, v in rows], SCHEMA), weights="count").collect()
    got = [(r.vec_id, k + 1, r.n, r.deviation, w, r.explained[k], r.identity_error) for r in found for k, w in enumerate(r.whitened)]
    assert {r.copies for r in found if r.vec_id >= 1000} == {301, 40}
    same(got, brute(rows, "count"))
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), weights="none")


@pytest.mark.parametrize("rows", [[], BAD[:5], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [2.0]), (4, [5.0])], [(i, [i * 1e6, float(i % 3) * 1e9]) for i in range(30)]])
def test_few_rows(spark, tmp_path, rows):
    got = [tuple(r) for r in op12_whitening(spark, frame(spark, tmp_path, rows)).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()]
    want = [(*w[:3], w[3] if w[3] < 2**63 else None, *w[4:]) for w in brute(rows)]
    if any(w[3] is None for w in want):
        key = lambda r: (r[0], r[1])
        assert [g[:4] for g in sorted(got, key=key)] == [w[:4] for w in sorted(want, key=key)]
    else:
        same(got, want)


def test_tables(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").collect()]
    got = [tuple(r) for r in op12_whitening(spark, f"{DATA}/sf0.01").select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()]
    assert len(got) == 4 * len(rows)
    same(got, brute(rows))
