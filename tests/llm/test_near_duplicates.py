import random

from terrasol.llm.near_duplicates import groups


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, similarity):
    sets, up = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}
    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= round(similarity * 100) * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3
    return words


def corpus():
    rng = random.Random(4)
    rows, k = [], 0
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.randrange(2, 12)):
            k += 1
            rows.append((k, " ".join(edited(rng, base, rng.randrange(0, 4)))))
    base = [f"v{i}" for i in range(200)]
    for i in range(400):  # a bunch of many blocks; neighbours differ little, far ones much
        k += 1
        rows.append((k, " ".join(edited(random.Random(i // 3), base, 3 + i % 3))))
    for i in range(100):
        k += 1
        rows.append((k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60)))))
    rows += [(k + 1, rows[0][1].upper()), (k + 2, None), (k + 3, "  \n"), (k + 4, "one two"), (k + 5, "One\ttwo"), (k + 6, "long " * 60_000)]
    return rows


def test_matches_all_pairs(spark):
    rows = corpus()
    want = brute(rows, 0.85)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int").repartition(5)
    for block in (256, 64):
        got = {r.doc_id: (r.n_shingles, r.component) for r in groups(frame, similarity=0.85, block=block).collect()}
        assert got == want


def test_edges(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f")]
    got = sorted(groups(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted((str(r.doc_id), str(r.component), r.kept) for r in got) == [("3", "3", True), ("3", "3", True), ("9", "3", False), ("None", "None", True)]
    assert groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_an_id_on_two_texts_links_both(spark):
    a = " ".join(f"a{i}" for i in range(80))
    b = " ".join(f"b{i}" for i in range(80))
    rows = [(5, a), (5, b), (7, b + " more"), (8, a + " more"), (9, "something else entirely, nothing shared at all"), (2, "own words of a row that stays alone")]
    got = {(r.doc_id, r.component) for r in groups(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.85).collect()}
    assert got == {(5, 5), (7, 5), (8, 5), (9, 9), (2, 2)}
