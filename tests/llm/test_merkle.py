import hashlib
import zlib

import duckdb
import pytest

from terrasol.llm.merkle import OP11_SQL, fold, manifest, op11_merkle_manifest
from pyspark.sql import functions as F
from tests.conftest import DATA

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, h string, g string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))


def tree(nodes):
    """(top, siblings of every node with their sides), by halving lists."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 2 * 2 : p // 2 * 2 + 2]
            paths[i].append((run[: p % 2], run[p % 2 + 1 :]))
            at[i] = p // 2
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in langs}
    root, up = tree([trees[g][0] for g in langs])
    out = []
    for g, more in zip(langs, up):
        for r, path in zip(groups[g], trees[g][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            f = leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r)
            for a, b in path + more:
                f = sha("".join(a) + f + "".join(b))
            out.append((r[0], leaf(r), trees[g][0], root, sha("".join("".join(a + b) for a, b in path + more)), f, f == root))
    return sorted(out, key=repr)


ROWS = (
    [(i, f"s{i % 3}", "en", i * 3, "word " * (i % 7), 1, "x", "y") for i in range(37)]
    + [(i, None, None, None, None, 1, "x", "y") for i in range(5)]
    + [(None, "a", "é", 5, "", 1, "x", "y"), (None, "b", "é", 5, "🙂é", 1, "x", "y"), (None, "b", "é", None, "", 1, "x", "y")]
    + [(9, "s", "z", 1, "same", 1, "x", "y")] * 6
    + [(11, "s", "fr", 2, "long " * 50_000, 1, "x", "y")]
    + [(7, "s", "Z", 1, "a", 1, "x", "y"), (7, "s", "Z", 1, "b", 1, "x", "y")]
)


@pytest.mark.parametrize("bits", [1, 2, 3, 10])
def test_equals_lists(spark, bits):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = manifest(df, bits=bits).withColumn("back", fold(F.col("leaf"), F.col("path"))).collect()
    assert all(r.back == r.root for r in got)
    want = brute(ROWS)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, sha("".join(s[1:] for s in r.path))) for r in got), key=repr) == sorted((w[:5] for w in want), key=repr)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:0], ROWS[5:8]])
def test_query_and_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert got == (brute(rows) if rows else [])
    if rows:
        assert {r[6] for r in got if r[0] in (4, 9)} <= {True, False}
        c = duckdb.connect()
        c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(c.sql(OP11_SQL).fetchall(), key=repr) == got


def test_tables_match_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/sf0.01/documents.parquet'")
    got = sorted(map(tuple, op11_merkle_manifest(spark, f"{DATA}/sf0.01").collect()), key=repr)
    assert got == sorted(c.sql(OP11_SQL).fetchall(), key=repr)
    assert 0 < sum(not r[6] for r in got) < len(got) / 3
