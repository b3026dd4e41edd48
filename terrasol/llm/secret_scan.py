"""Secret scan by a battery of randomness tests, in DataFrame functions only.

Base rules find assignments, access keys and long hexadecimal runs.  Beside them every
long run of code characters is a candidate: its encoding is inferred from the
characters it uses, three tests ask whether it could be uniform random symbols of that
encoding (chi-squared of the symbol counts, Wald-Wolfowitz runs of the upper half of
the alphabet, lag-one serial correlation), their p-values are combined by Fisher's
rule, and within each length band the Benjamini-Hochberg step-up rejects the
candidates that are not random.  What stays is reported as kind `random`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasol.llm.common import cut, table

#: a candidate is a run of so many code characters at least
LEAST_LENGTH = 20
#: false-discovery rate of the rejections of randomness
RATE = 0.05
#: matches whose places are added up together
STRETCH = 128
#: p-values are counted in so many classes per decade
STEPS = 50

# The rules of the base kinds, in the order of the contract.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

# Alphabets by inferred encoding.
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "base32": UPPER + "234567",
    "lower36": DIGITS + LOWER,
    "upper36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": DIGITS + UPPER + LOWER + "+/",
    "base64url": DIGITS + UPPER + LOWER + "-_",
}
CODE_RUN = r"[A-Za-z0-9+/_-]{%d,}"
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
EMPTY = f"cast(array() as {SPAN})"


def _once(value: Column, use) -> Column:
    """`use` of a value that is computed once, and not for every element it meets."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _place(matches: Column, gaps: Column, values: Column, least: int, kind: int) -> Column:
    """Code-point spans of a rule's matches: the texts between matches and the matches
    themselves alternate, so running lengths give the positions.  Lengths are added up over stretches of STRETCH
    matches first and then inside each, so the work grows with the matches and not with their square."""
    size = lambda x: (F.length(x["gaps"]) + F.coalesce(F.length(x["matches"]), F.lit(0))).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gaps"])
        end = acc["at"] + size(x)
        one = F.array(F.struct(begin.cast("bigint").alias("start"), F.lit(kind).alias("kind"), end.cast("bigint").alias("end")))
        good = F.coalesce(F.length(x["values"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def inside(stretch: Column, at: Column) -> Column:
        return F.aggregate(stretch, F.struct(at.alias("at"), F.expr(EMPTY).alias("out")), step, lambda acc: acc["out"])

    def spans(stretches: Column) -> Column:
        lengths = F.transform(stretches, lambda z: F.aggregate(z, F.lit(0).cast("bigint"), lambda acc, x: acc + size(x)))
        starts = F.aggregate(lengths, F.array(F.lit(0).cast("bigint")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(stretches, F.slice(starts, F.lit(1), F.size(stretches)), inside))

    zipped = F.arrays_zip(matches.alias("matches"), gaps.alias("gaps"), values.alias("values"))
    cut_up = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / STRETCH).cast("int")), lambda i: F.slice(z, i * STRETCH + 1, F.lit(STRETCH)))
    return _once(zipped, lambda z: _once(cut_up(z), spans))


def _found(text: Column, rule: str, group: int, least: int, kind: int, hint: str) -> Column:
    """Spans of one rule; texts without the cheap hint are not searched."""
    every = F.regexp_extract_all(text, F.lit(rule), F.lit(0))
    values = every if group == 0 else F.regexp_extract_all(text, F.lit(rule), F.lit(group))
    return F.when(text.rlike(hint), _place(every, F.split(text, rule, -1), values, least, kind)).otherwise(F.expr(EMPTY))


def _tail(z: Column) -> Column:
    """Upper tail of the normal law, logistic form (error below 2e-4)."""
    z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(z * 1.5976 + z * z * z * 0.070565))


def _alphabet(token: Column) -> Column:
    """The smallest alphabet that holds the token; null unless it mixes digits and letters."""
    return (
        F.when(~token.rlike("[0-9]") | ~token.rlike("[A-Za-z]"), F.lit(None))
        .when(token.rlike("^[0-9a-f]+$"), ALPHABETS["hex"])
        .when(token.rlike("^[A-Z2-7]+$"), ALPHABETS["base32"])
        .when(token.rlike("^[0-9a-z]+$"), ALPHABETS["lower36"])
        .when(token.rlike("^[0-9A-Z]+$"), ALPHABETS["upper36"])
        .when(token.rlike("^[0-9A-Za-z]+$"), ALPHABETS["base62"])
        .when(token.rlike("^[0-9A-Za-z+/]+$"), ALPHABETS["base64"])
        .when(token.rlike("^[0-9A-Za-z_-]+$"), ALPHABETS["base64url"])
    )


def _without(text: Column, part) -> Column:
    return F.length(F.replace(text, part if isinstance(part, Column) else F.lit(part), F.lit("")))


def _statistics(token: Column, alphabet: Column) -> Column:
    """Struct of n, k and what the three tests need; linear in the token's length."""
    n = F.length(token).cast("double")
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(F.pow(n - _without(token, c), F.lit(2.0))))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("s", "q", "x", "last")))

    def step(acc: Column, c: Column) -> Column:
        v = (F.instr(alphabet, c) - 1).cast("double")
        return F.when(c == "", acc).otherwise(F.struct((acc["s"] + v).alias("s"), (acc["q"] + v * v).alias("q"), (acc["x"] + acc["last"] * v).alias("x"), v.alias("last")))

    # alternate symbols are marked, so that digits and letters fall on both sides
    marked = F.call_function("translate", token, alphabet, F.rpad(F.lit(""), 64, "01"))
    return F.struct(n.alias("n"), F.length(alphabet).cast("double").alias("k"), squares.alias("squares"), F.aggregate(F.split(token, ""), zero, step).alias("m"), _without(marked, "1").cast("double").alias("zeros"), ((2 * n - _without(marked, "01") - _without(marked, "10")) / 2 + 1).alias("runs"))


def _combined(t: Column) -> Column:
    """Fisher's combination of the three p-values."""
    n, k = t["n"], t["k"]
    free = k - 1
    chi = F.greatest(t["squares"] * k / n - n, F.lit(0.0))
    chi_z = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    ones = n - t["zeros"]
    mean = 2 * ones * t["zeros"] / n + 1
    runs_z = F.abs(t["runs"] - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    mu = t["m"]["s"] / n
    variance = F.greatest(t["m"]["q"] / n - mu * mu, F.lit(1e-9))
    serial_z = F.abs(t["m"]["x"] - (n - 1) * mu * mu) / (n * variance) * F.sqrt(n)
    logs = [F.log(F.least(F.greatest(p, F.lit(1e-30)), F.lit(1.0))) for p in (_tail(chi_z), 2 * _tail(runs_z), 2 * _tail(serial_z))]
    half = -(logs[0] + logs[1] + logs[2])
    return F.exp(-half) * (1 + half + half * half / 2)


def _candidates(text: Column, least: int) -> Column:
    """array<struct<start, end, band, step>>: band is the log2 of the length in halves,
    step counts the decades of the combined p-value."""
    rule = CODE_RUN % least
    spans = _found(text, rule, 0, least, len(KINDS) - 1, f"[A-Za-z0-9+/_-]{{{least}}}")
    with_token = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("token")))
    with_alphabet = F.filter(F.transform(with_token, lambda s: F.struct(s["start"], s["end"], s["token"], _alphabet(s["token"]).alias("alphabet"))), lambda s: s["alphabet"].isNotNull())
    tested = F.transform(with_alphabet, lambda s: F.struct(s["start"], s["end"], _statistics(s["token"], s["alphabet"]).alias("t")))
    scored = F.transform(tested, lambda s: F.struct(s["start"], s["end"], F.floor(F.log2(s["t"]["n"]) * 2).cast("int").alias("band"), _combined(s["t"]).alias("p")))
    return F.transform(scored, lambda s: F.struct(s["start"], s["end"], s["band"], F.floor(F.log10(F.greatest(s["p"], F.lit(1e-30))) * STEPS).cast("int").alias("step")))


def rejected_steps(found: DataFrame, rate: float) -> DataFrame:
    """Benjamini-Hochberg per length band over p-value classes: (band, limit), the
    highest class whose tokens are rejected as not random.  A class counts with its
    upper edge, so the rate holds.  One row per band and class is all that is ordered."""
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.band", "c.step").count()
    w = "partition by band"
    return (
        counts.selectExpr("band", "step", f"sum(count) over ({w} order by step) as up_to", f"sum(count) over ({w}) as of_all")
        .where(F.pow(F.lit(10.0), (F.col("step") + 1) / F.lit(float(STEPS))) <= F.lit(rate) * F.col("up_to") / F.col("of_all"))
        .groupBy("band")
        .agg(F.max("step").alias("limit"))
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, rate: float = RATE) -> DataFrame:
    """One row per input row: id, `base` and `spans` (arrays of start, kind index, end in
    code points, ordered by start and kind).

    A null text is empty and has no spans; ids may be null or repeat; an empty table
    gives an empty result; other columns are not looked at.  Random spans that
    overlap a base span are not repeated.  The candidates' tests are written once to the
    shared folder, the thresholds are one row for each length band (under 130 for any length).
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    base = F.array_sort(
        F.concat(
            _found(text, ASSIGN, 1, 6, 0, "(?i)pass|secret|token|api"),
            _found(text, ACCESS, 0, 20, 1, "AKIA"),
            _found(text, HEX, 0, 24, 2, "[0-9a-f]{24}"),
        )
    )
    found = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).select("_id", base.alias("base"), _candidates(text, least).alias("candidates")))
    limits = rejected_steps(found, rate).agg(F.map_from_entries(F.collect_list(F.struct("band", "limit"))).alias("limits"))
    free = F.filter(F.col("candidates"), lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])) & (c["step"] > F.coalesce(F.try_element_at(F.col("limits"), c["band"]), F.lit(-(10**6)))))
    random = F.transform(free, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), c["end"].alias("end")))
    return found.crossJoin(F.broadcast(limits)).select(F.col("_id").alias(id_col), "base", F.array_sort(F.concat("base", random)).alias("spans"))


def counted(spans: str, kind: int) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat(F.get(name, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    number = [counted("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return out.select("doc_id", *number, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
