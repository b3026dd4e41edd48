"""Personal data by bootstrapped contextual extraction.

Four exact rules (email, ip, card, phone) give the base spans; their values are the seed
entities.  The words beside a seed (up to white space or a separator like a colon) are lexical patterns.  Spark then scores the graph of
patterns and instances in rounds: a pattern is as good as the share of its occurrences
in the whole corpus that hold a good instance, an instance as good as the noisy-or of its
patterns.  Patterns of high confidence with enough seeds reveal identifiers that no
rule knows (social security, account, passport numbers, handles), as kind `context`.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasol.llm.common import cut, small_batches, table

KINDS = ("email", "ip", "card", "phone", "context")
#: a pattern counts from so many different seeds on
SEEDS = 3
#: confidence from which a pattern reveals instances
CONFIDENCE = 0.5
ROUNDS = 3
#: context words longer than this are no patterns
WORD = 40

# The rules of the contract.  The looks behind only skip starts inside a run
# of digits, where no match can begin that did not begin at the run's start.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: what may be an identifier that no rule knows: digits with separators and at most four
#: letters before them, or a handle
UNKNOWN = re.compile(r"(?<![^\s:=,;(\"'])(?:[A-Za-z]{0,4}[0-9][0-9./-]{4,}[0-9]|@[A-Za-z0-9_]{3,})(?![^\s,;.)\"'])")
#: a lexical unit: a word up to white space, or to the separators that may stand right before an identifier
GLUE = ":=,;(\"'"
UNIT = re.compile(r"[^\s:=,;(\"']*[:=,;(\"']+|[^\s:=,;(\"']+")
REST = re.compile(r"\S*")
DIGIT_OR_AT = re.compile("[0-9@]")

FOUND = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
EDGE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])
SPAN_SQL = "array<struct<start:bigint,kind:int,end:bigint>>"
EDGE_SQL = "array<struct<start:bigint,end:bigint,instance:string,seed:boolean,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards: linear in the text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four rules, ordered."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _beside(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns: the unit before and the unit after, case-folded.  What stands between is blank, so each
    occurrence of a unit is beside one instance on either side at most and counts alike in the corpus."""
    left = text[max(0, start - WORD - 24) : start].lower()
    right = text[end : end + WORD + 24].lower()
    found = []
    if left and (left[-1].isspace() or left[-1] in GLUE):
        units = UNIT.findall(left)
        if units and 1 < len(units[-1]) <= WORD:
            found.append("L " + units[-1])
    rest = REST.match(right)  # the rest of the instance's own word
    m = UNIT.search(right, rest.end())
    if m and 1 < len(m[0]) <= WORD:
        found.append("R " + m[0])
    return found


def _named(text: str) -> str:
    """An instance as a node of the graph: itself, or its 128-bit hash where it is long."""
    low = text.lower()
    return low if len(low) <= 64 else "#" + xxhash.xxh3_128_hexdigest(low)


def _instances(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    found = [{"start": a, "end": b, "instance": _named(text[a:b]), "seed": True, "patterns": _beside(text, a, b)} for a, _, b in spans]
    at = 0
    for m in UNKNOWN.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][2] <= a:
            at += 1
        if at < len(spans) and spans[at][0] < b or sum(map(str.isdigit, m[0])) < 6 and m[0][0] != "@":
            continue
        found.append({"start": a, "end": b, "instance": _named(m[0]), "seed": False, "patterns": _beside(text, a, b)})
    return found


def _extract(batches):
    for batch in batches:
        bases, edges = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text) if text and DIGIT_OR_AT.search(text) else []
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            edges.append(_instances(text, spans) if spans or text and DIGIT_OR_AT.search(text) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(FOUND)), pa.array(edges, pa.list_(EDGE))], ["_id", "base", "edges"])


def _word_counts(batches):
    """Occurrences of every context word in a task's texts; the counter is handed on
    whenever it grows large, so memory stays bounded."""
    counts: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(w for w in UNIT.findall(text.lower()) if len(w) <= WORD) if text else None
        if len(counts) > 300_000:
            yield rows()
            counts.clear()
    if counts:
        yield rows()


def pattern_scores(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS) -> DataFrame:
    """(pattern, confidence) after some rounds over the pattern-instance graph.

    edges: pattern, instance, seed, n.  totals: pattern, total.  Every round is two
    keyed aggregations with partial sums, so a frequent pattern does not gather in a task;
    each round is cut to the shared folder.
    """
    known = edges.groupBy("pattern").agg(F.count_if("seed").alias("seeds")).where(F.col("seeds") >= seeds).join(totals, "pattern")
    live = cut(edges.join(known, "pattern"))
    scores = live.groupBy("instance").agg(F.max("seed").cast("int").cast("double").alias("score"))
    confidence = None
    for _ in range(rounds):
        confidence = live.join(scores, "instance").groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.max("total") + 2)).alias("confidence"))
        confidence = cut(confidence)
        ors = live.join(confidence, "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), F.sum(F.log1p(-F.least("confidence", F.lit(0.95)))).alias("doubt"))
        scores = cut(ors.select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("score")))
    return confidence


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = CONFIDENCE) -> DataFrame:
    """One row per input row: id, `base` and `spans` (arrays of start, kind index, end in
    code points, ordered by start and kind).

    A null text is empty; ids may be null or repeat (rows are kept apart by an own row
    number written with them); an empty table gives an empty result; other columns
    are not looked at.  An instance occurring twice is judged at each place by the
    patterns there.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    marked = texts.select("_id", F.when(F.col("_text").rlike("[0-9@]"), F.col("_text")).alias("_text"))
    found = cut(marked.mapInArrow(_extract, f"_id {kind}, base {SPAN_SQL}, edges {EDGE_SQL}").withColumn("_row", F.monotonically_increasing_id()))
    places = found.select("_row", F.explode("edges").alias("e")).select("_row", "e.start", "e.end", "e.instance", "e.seed", F.explode("e.patterns").alias("pattern"))
    edges = cut(places.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")))
    counts = texts.select("_text").mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("total"))
    wanted = edges.select("pattern", F.substring("pattern", 3, WORD).alias("word")).distinct()
    totals = wanted.join(counts, "word").select("pattern", "total")
    good = pattern_scores(edges, totals).where(F.col("confidence") >= confidence).select("pattern")
    new = places.where(~F.col("seed")).join(good, "pattern", "left_semi")
    spans = new.groupBy("_row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("new"))
    out = found.select("_row", "_id", "base").join(spans, "_row", "left")
    return out.select(F.col("_id").alias(id_col), "base", F.array_sort(F.concat("base", F.coalesce("new", F.expr(f"cast(array() as {SPAN_SQL})")))).alias("spans"))


def counted(spans: str, kind: int) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat(F.get(name, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "documents", "doc_id", "text"))
    number = [counted("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return out.select("doc_id", *number, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
