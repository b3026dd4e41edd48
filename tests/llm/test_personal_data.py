import hashlib
import random
import re

from terrasol.llm.personal_data import base_spans, extract, joined, luhn, op1_personal_data
from tests.conftest import DATA

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(re.sub("[ -]", "", m[0])) <= 19 and luhn(re.sub("[ -]", "", m[0]))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_rules_on_random_texts():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", ".", "x-y", "10", "255", "256.1", "1.2.3.4", " ", "-", "+1", "(555)", "4111 1111 1111 1111", "4111-1111", "é", "_", "%", "..", "@@", "co.uk", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert base_spans(text) == plain_spans(text), text


def test_query_matches_regex(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    names = ["email", "ip", "card", "phone"]
    for r in op1_personal_data(spark, f"{DATA}/sf0.001").collect():
        spans = plain_spans(docs[r.doc_id])
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(text.split(",")) <= set(r.spans.split(",")) or not text


def test_contexts_reveal_unseen_identifiers(spark):
    rows = [(i, f"please write to mailto: user{i}@mail.example.com today") for i in range(6)]
    rows += [(10, "reach me, mailto: 123-45-6789 today"), (11, "the number 123-45-6780 stands alone here"), (12, None), (13, ""), (None, "x@y.zz"), (13, "x" * 200_000 + " a@b.cd")]
    got = {(r.doc_id, r.spans) for r in extract(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", joined("spans").alias("spans")).collect()}
    by = {}
    for d, s in got:
        by.setdefault(d, []).append(s)
    assert by[10] == ["context:18:29"] and by[11] == [""] and by[12] == [""] and by[None] == ["email:0:6"]
    assert sorted(by[13]) == ["", "email:200001:200007"]
    assert extract(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_runs_of_digits():
    assert [k for _, k, _ in base_spans("0" * 5000 + ".1.1.1 and " + "9" * 5000 + ".1.1.1")] == [1]


def test_context_finds_what_rules_do_not_know(spark):
    """Glued labels count like spaced ones; precision and recall on planted identifiers."""
    rows, planted = [], set()
    for i in range(60):
        rows.append((i, f"see ssn:user{i}@mail.org today"))
    rows.append((60, "a lone ssn: here"))
    for i in range(61, 81):
        rows.append((i, f"his ssn:{i}3-45-6789 was noted, order {i}00-1234-77 came"))
        planted.add((i, f"context:8:{8 + len(f'{i}3-45-6789')}"))
    rows += [(i, f"order {i}00-1234-55 arrived with nothing personal") for i in range(81, 140)]
    out = extract(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r.doc_id, s) for r in out.select("doc_id", joined("spans").alias("s")).collect() for s in r.s.split(",") if s.startswith("context")}
    assert found == planted
