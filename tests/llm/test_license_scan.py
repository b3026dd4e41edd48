import math
import re

import duckdb
import pytest

from terrasol.llm import license_scan as L
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, places string, n_words int, label string"
MIT = next(t for label, _, t in L.TEMPLATES if label == "mit")
GPL = next(t for label, _, t in L.TEMPLATES if label == "gpl-3.0" and len(t) > 100)

#: what the contract asks of base columns
BASE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d),
f AS (SELECT k, i - 1 AS i, CASE WHEN w[i] = 'mit' AND w[i+1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i+1] = 'license' THEN 'apache'
      WHEN w[i] = 'general' AND w[i+1] = 'public' AND w[i+2] = 'license' THEN 'gpl' END AS label FROM p),
a AS (SELECT k, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f WHERE label IS NOT NULL GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN a USING (k)
"""


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts):
    """(n_words, n_base, first, last, base labels, labels, score) per text: every alignment of every template, no index."""
    docs = [split(t) for t in texts]
    raw = [(label, True, p.split(), [], 1.0) for p, label in L.PHRASES.items()] + [(label, False, split(t), [k.split() for k in keys], L.SHARE) for label, keys, t in L.TEMPLATES]
    sets = [set(d) for d in docs]
    idf = {w: math.log(1 + len(docs) / (1 + sum(w in s for s in sets))) for _, _, t, _, _ in raw for w in t}
    out = []
    for doc in docs:
        base, labels, best = [], set(), 0.0
        for label, is_base, text, keys, share in raw:
            total, slack = sum(idf[w] for w in text), 0 if is_base else len(text) // L.LOOSE
            # the alignments: those of words without which the rest is too light
            rare, left = [], total
            for w in sorted(set(text), key=lambda w: -idf[w]):
                if left < share * total - 1e-7:
                    break
                rare.append(w)
                left -= idf[w] * text.count(w)
            for d in sorted({i - o for i, w in enumerate(doc) if w in rare for o, v in enumerate(text) if v == w}):
                score = sum(idf[w] for o, w in enumerate(text) if w in doc[max(0, d + o - slack) : max(0, d + o + slack + 1)])
                held = doc[max(0, d - slack) : max(0, d + len(text) + slack)]
                if score >= share * total - 1e-9 and all(any(held[i : i + len(k)] == k for i in range(len(held))) for k in keys):
                    labels.add(label)
                    best = max(best, score / total)
                    if is_base:
                        base.append((d, label))
        at = [d for d, _ in base]
        out.append((len(doc), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(best, 9)))
    return out


def found(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op13_license_scan(spark, str(tmp_path)).collect()
    return [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got]


TEXTS = [
    None,
    "",
    "Released under the MIT License. mit  LICENSE; Apache-License, general public license general public general public license",
    "MIT licence and apache 2 license, the general public",
    f"Copyright 2020 someone. {MIT} The end.",
    "intro " * 30 + MIT.replace("person", "natural person").replace("sublicense, ", "").upper() + " MIT License",
    MIT.replace("free of charge", "for a fee"),  # the key phrase is broken
    MIT[: len(MIT) // 2],
    GPL + " " + GPL.replace("version 3", "version 2"),
    "Licensed under CC BY-NC 4.0. Licensed under CC-BY-SA 4.0",
    "license " * 3000 + "mit license " * 500 + "redistribute " * 300,
    "word " * 60_000 + GPL + " word" * 60_000,
    "merchantability permission ümlaut-mit 许可 license",
]


def test_equals_brute_force(spark, tmp_path):
    texts = TEXTS + ["plain prose of the public"] * 40
    rows = [(i if i else None, t, "x", 1, "y") for i, t in enumerate(texts)] + [(3, TEXTS[3], "x", 1, "y")]
    got = sorted(found(spark, rows, tmp_path), key=repr)
    want = brute([r[1] for r in rows])
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    by = {g[0]: g for g in got}
    assert by[4][6] == "mit" and by[4][5] == "" and "mit" in by[5][6] and by[6][6] == by[7][6] == ""
    assert by[8][6] == "gpl,gpl-2.0,gpl-3.0" and "cc-by-nc-4.0" in by[9][6] and by[11][6] == "gpl,gpl-3.0" and by[10][2] == 500


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == []
    assert L.scan(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"), templates=(), phrases={}).first().places == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_base_columns_match_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/{sf}/documents.parquet'")
    rows = L.op13_license_scan(spark, f"{DATA}/{sf}").collect()
    got = sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows], key=repr)
    assert got == sorted(c.sql(BASE_SQL).fetchall(), key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").orderBy("doc_id").collect()]
    # documents without a notice have no label, those with one have its label
    by = {r.doc_id: r.labels for r in rows}
    for i, t in enumerate(texts):
        assert ("cc-by-nc-4.0" in by[i].split(",")) == ("Licensed under CC BY-NC 4.0." in t)
        assert ("gpl-3.0" in by[i].split(",")) == ("GNU General Public License, version 3." in t)
