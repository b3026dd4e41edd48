"""Merkle manifest of a dataset: lag and lead windows level by level.

Every row is a leaf.  The leaves of a group stand in the order of their key; two
neighbours become their parent until one node is left, the group's subroot, and the subroots of
all groups go the same way to the root.  A node is held by the row of its first leaf, so at
level k the node beside it is exactly 2^k rows away: lag and lead columns of that
offset, masked by the slot (bit k of the position) and the length of the run, give every sibling, and
rows that are first children hash their parents.

A window never holds a group: positions are cut into aligned blocks of 2^BITS, whose tops are
the nodes of the next pass.  Positions come from a range partitioning and the counts of its partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasol.llm.common import crc_mod, cut, table

#: levels of a pass; a block, the largest partition of a window, has 2^BITS rows
BITS = 10
#: rows of a range partition
RANGE_ROWS = 1 << 15
#: fields of a leaf, in their order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: rows whose checksum is a multiple of it are tampered with in the query
TAMPERED = 7


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts joined together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(**values: Column) -> Column:
    """Digest of a row's values in the given order: `-` for null, else bytes, `:`, value."""
    text = [v.cast("string") for v in values.values()]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its path give: `<` before a left sibling, `>` before a right one, `=` for
    a node that is alone in its run."""

    def up(acc: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return digest(F.when(s.startswith("<"), other).otherwise(""), acc, F.when(s.startswith(">"), other).otherwise(""))

    return F.aggregate(path, node, up)


def siblings(path: Column) -> Column:
    """Digest of the siblings on a path, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)


def _positions(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(nodes with their position `pos` in group `g` and the group's size `n`, the largest size).

    `nodes` is a written table; a group may fill many range partitions.
    """
    parts = max(1, -(-nodes.count() // RANGE_ROWS))
    ranged = cut(nodes.repartitionByRange(parts, "g", *order).withColumn("_part", F.spark_partition_id()))
    whole = Window.partitionBy("g")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("g", "_part").agg(F.count("*").alias("_c"))
    counts = cut(counts.select("g", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("n")))
    within = F.row_number().over(Window.partitionBy("g", "_part").orderBy(*order))
    placed = ranged.join(counts, ["g", "_part"]).withColumn("pos", F.col("_before") + within - 1)
    return placed.drop("_part", "_before"), counts.agg(F.max("n")).first()[0] or 0


def _climb(nodes: DataFrame, most: int, bits: int) -> DataFrame:
    """One pass: every row's siblings inside its block (`path`), and at a block's first row its top (`h`)."""
    pos, n = F.col("pos"), F.col("n")
    df = nodes.withColumn("block", F.shiftright("pos", bits))
    window = Window.partitionBy("g", "block").orderBy("pos")
    levels = min(bits, max(0, most - 1).bit_length())
    for k in range(levels):
        step = 1 << k
        node = (pos.bitwiseAND(F.lit(step - 1)) == 0) & (n > step)
        second = pos.bitwiseAND(F.lit(step)) != 0
        followed = ~second & (pos + step < n)
        df = df.withColumns({"_l": F.lag("h", step).over(window), "_r": F.lead("h", step).over(window)})
        side = F.when(node & second, F.concat(F.lit("<"), F.col("_l"))).when(node & followed, F.concat(F.lit(">"), F.col("_r"))).when(node, "=")
        parent = F.when(node & followed, digest(F.col("h"), F.col("_r"))).when(node & ~second, digest(F.col("h"))).otherwise(F.col("h"))
        df = df.withColumns({f"_s{k}": side, "h": parent}).drop("_l", "_r")
    # a row's node at a level is the last first child at or before it
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [F.last(f"_s{k}", ignorenulls=True).over(upto) for k in range(levels)]
    path = F.array_compact(F.array(*sides)) if sides else F.expr("cast(array() as array<string>)")
    return df.withColumn("path", path).drop(*(f"_s{k}" for k in range(levels)))


def _passes(nodes: DataFrame, most: int, bits: int) -> list[DataFrame]:
    """The written tables of all passes, leaves first."""
    out = [cut(_climb(nodes, most, bits))]
    while most > 1 << bits:
        most = -(-most >> bits)
        tops = out[-1].where(F.col("pos").bitwiseAND(F.lit((1 << bits) - 1)) == 0)
        up = tops.select("g", F.shiftright("pos", bits).alias("pos"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), "h")
        out.append(cut(_climb(up, most, bits)))
    return out


def _whole_paths(tables: list[DataFrame]) -> DataFrame:
    """The first table's rows with the paths of their blocks' tops appended; a key has a block's rows at most."""
    above = tables[-1]
    for t in reversed(tables[:-1]):
        up = above.select("g", F.col("pos").alias("block"), F.col("path").alias("_up"), *(c for c in ("subroot", "root") if c in above.columns))
        above = t.join(up, ["g", "block"]).withColumn("path", F.concat("path", "_up")).drop("_up")
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", key_col: str = "doc_id", bits: int = BITS, **also: Column) -> DataFrame:
    """One row per input row: its key, `leaf`, `path` (siblings from the leaf to the root, see `fold`), `subroot`,
    `root`, and the columns of `also`, computed from the row.

    Groups stand in order of their UTF-8 bytes, null first; leaves in order of their key, null
    first, ties by their digest (rows that are equal in all fields are interchangeable). A group or table of one row has
    that leaf as its subroot or root. An empty table gives an empty result. Empty texts
    are values of 0 bytes, long ones are hashed whole, null fields are `-`; other columns are not looked at.
    """
    group = F.col(group_col).cast("string")
    # `-` sorts before `v`, so null groups come first and are keys like others
    named = F.when(group.isNull(), "-").otherwise(F.concat(F.lit("v"), group))
    one = docs.select(named.alias("g"), F.col(key_col).alias("_key"), leaf(**{c: F.col(c) for c in fields}).alias("h"), F.struct(F.lit(0).alias("_"), *(v.alias(k) for k, v in also.items())).alias("_also"))
    leaves = cut(one.withColumns({"leaf": F.col("h"), "_row": F.monotonically_increasing_id()}))
    placed, most = _positions(leaves, ["_key", "h", "_row"])
    tables = _passes(placed, most, bits)
    tops = cut(tables[-1].where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), "h", F.col("h").alias("subroot")))
    placed, most = _positions(tops, ["name"])
    upper = _passes(placed, most, bits)
    top = upper[-1].where("pos = 0").select("h").first()
    groups = _whole_paths(upper).select(F.col("name").alias("g"), "subroot", F.lit(top[0] if top else None).cast("string").alias("root"), F.col("path").alias("_up"))
    # the uppermost table has a block's rows at most for a group
    tables[-1] = tables[-1].join(groups, "g").withColumn("path", F.concat("path", "_up")).drop("_up")
    out = _whole_paths(tables)
    return out.select(F.col("_key").alias(key_col), "leaf", "path", "subroot", "root", *(F.col(f"_also.`{k}`").alias(k) for k in also))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *FIELDS)
    hit = F.coalesce(crc_mod("doc_id", TAMPERED) == 0, F.lit(False))
    values = {c: F.col(c) for c in FIELDS} | {"n_chars": F.col("n_chars") + F.when(hit, 1).otherwise(0)}
    folded = manifest(docs, tampered=leaf(**values)).withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 24, group_levels: int = 12) -> str:
    """The manifest in SQL: every level a table of nodes (g, pos, h, c nodes in the group), siblings by join."""
    enc = lambda c: f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"
    row = lambda n_chars: " || ".join(enc(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", n_chars, "text"))
    crc = "(SELECT doc_id, CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS hit FROM crcs)"
    out = [
        # crc32 by bits: the polynomial reversed, over the decimal text of an id
        "WITH RECURSIVE steps AS MATERIALIZED (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL)",
        "codes AS MATERIALIZED (SELECT CAST(i AS BIGINT) AS i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i))",
        "tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS v FROM codes)",
        "crcs AS MATERIALIZED (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, tab.v[xor(c % 256, b) + 1])), 4294967295) AS crc FROM steps, tab)",
        f"leaves AS MATERIALIZED (SELECT d.doc_id, d.lang, sha256({row('n_chars')}) AS leaf, sha256({row('n_chars + hit')}) AS bad FROM (SELECT documents.*, coalesce(hit, 0) AS hit FROM documents LEFT JOIN {crc} USING (doc_id)) d)",
        "placed AS MATERIALIZED (SELECT *, coalesce('v' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS c FROM leaves)",
        "a0 AS MATERIALIZED (SELECT g, pos, leaf AS h, c FROM placed)",
        "p0 AS MATERIALIZED (SELECT doc_id, leaf, g, pos, bad AS f, '' AS proof FROM placed)",
    ]

    def level(kind: str, proof: str, k: int) -> None:
        out.append(f"{kind}{k + 1} AS MATERIALIZED (SELECT g, pos // 2 AS pos, CASE WHEN min(c) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h, (min(c) + 1) // 2 AS c FROM {kind}{k} GROUP BY g, pos // 2)")
        other = f"SELECT p.*, coalesce(s.h, '') AS s, n.c AS c FROM {proof}{k} p JOIN {kind}{k} n ON n.g = p.g AND n.pos = p.pos LEFT JOIN {kind}{k} s ON s.g = p.g AND s.pos = xor(p.pos, 1)"
        out.append(f"{proof}{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (s, c) REPLACE (pos // 2 AS pos, CASE WHEN c = 1 THEN f WHEN pos % 2 = 1 THEN sha256(s || f) ELSE sha256(f || s) END AS f, CASE WHEN c = 1 THEN proof ELSE proof || s END AS proof) FROM ({other}))")

    for k in range(levels):
        level("a", "p", k)
    out.append(f"names AS MATERIALIZED (SELECT g AS name, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS nth, count(*) OVER () AS c FROM a{levels})")
    out.append("b0 AS MATERIALIZED (SELECT '' AS g, nth AS pos, subroot AS h, c FROM names)")
    out.append(f"q0 AS MATERIALIZED (SELECT doc_id, leaf, '' AS g, nth AS pos, f, proof, subroot FROM p{levels} JOIN names ON name = g)")
    for k in range(group_levels):
        level("b", "q", k)
    return ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, b{group_levels}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b{group_levels}.h AS verified FROM q{group_levels}, b{group_levels}"


OP11_SQL = _sql()
