"""Main text of web pages by deduced templates.

Elements (named by their path of tags and classes) of all pages of a host get an
occurrence vector: how often each stands on every page.  Spark folds the vectors to sums of
hashes, so elements with equal vectors form an equivalence class by equal sums.  Frequent classes
of elements that stand once on their pages are the template; they nest by their paths.
What lies between are its slots.  Those whose text varies between pages are judged by their place: the deepest template
element that holds nearly all varying, unlinked text is the article's region, and the slots below it stay.  A
slot beside it stays if its text is each page's own, as a title's is (an advert's or a footer's comes back
on other pages), or if it is inside an article element.  Tags and class names (`tags`) take parts out (a class name if all its words
say so), and decide where pages are too few to tell.  A page of which no slot is left is its own template.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasol.llm.common import cut, small_batches, table

#: share of a host's different pages on which a template class stands
SUPPORT = 0.5
#: share of a host's varying, unlinked characters that the article's region holds
REGION = 0.8
#: share of different texts from which on a slot's text is each page's own
OWN = 0.95
#: slots of all hosts that are broadcast (17 bytes each); beyond, pages are joined by host
SLOTS = 1_000_000
#: the same text on fewer pages does not take a slot out of an article element
FEW = 4

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript iframe template svg object select canvas math xmp title".split())
BLOCK = frozenset("html head body article main section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre form fieldset figure figcaption address details summary hr center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_TEXT = frozenset("nav header footer aside form button menu dialog head fieldset label".split())
#: words of class and id names that mark what is not the article
NOT_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottom cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations widget toolbar pagination pager copyright legal disclaimer".split()
)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<!--|<[!?/][^>]*>?|<[a-zA-Z][^>]*>?")
#: words that say nothing beside one of these
PLAIN_WORDS = frozenset("main top left right inner outer list item items box block container wrapper wrap area section content text link links bar row col column site page global primary secondary footer header title body group panel".split())
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NONE = re.compile(r"display\s*:\s*none", re.I)
#: elements below so many others are their deepest one's children, as in browsers
DEPTH = 512
WORDS = re.compile(r"[a-z0-9]+")
BLANK = re.compile(r"[ \t\n\r\f\v   　]+")


class Element:
    """An open element: its path's name, and whether text in it counts."""

    __slots__ = ("tag", "path", "out", "linked", "inside", "parent", "depth", "block")

    def __init__(self, tag, path, out, linked, inside, parent):
        self.tag, self.path, self.out, self.linked, self.inside, self.parent = tag, path, out, linked, inside, parent
        self.depth = parent.depth + 1 if parent else 0
        #: the block whose text this element's text is
        self.block = self if parent is None or tag in BLOCK else parent.block

    def above(self) -> list[int]:
        """Paths from the outermost element down to this one."""
        found, e = [], self
        while e.parent is not None:
            found.append(e.path)
            e = e.parent if e.depth <= DEPTH else e.parent.at(DEPTH)
        return found[::-1]

    def at(self, depth: int) -> Element:
        e = self
        while e.depth > depth:
            e = e.parent
        return e


def _attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), ""))
    return found


def _says_no(name: str) -> bool:
    """Whether a class or id name marks what is not the article: one of its words does, and no word says otherwise."""
    words = set(WORDS.findall(name.lower()))
    return not words.isdisjoint(NOT_WORDS) and words <= NOT_WORDS | PLAIN_WORDS


def _name(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _open(parent: Element, tag: str, attributes: str, tags: bool) -> Element:
    names = _attributes(attributes) if attributes and not attributes.isspace() else {}
    classes = names.get("class", "").lower().split()
    path = _name(f"{(parent if parent.depth < DEPTH else parent.at(DEPTH)).path}>{tag}" + "".join(f".{w}" for w in sorted(set(classes))))
    role = names.get("role", "").lower()
    inside = tags and (parent.inside or tag in ("article", "main") or role == "main")
    out = parent.out
    if not tags:
        pass
    elif tag in HEADINGS and parent.tag == "header" and parent.inside:
        out = False  # an article's own title
    elif tag in NOT_TEXT or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog"):
        out = True
    elif tag not in ("html", "body", "article", "main") and not out and names:
        out = any(map(_says_no, [*classes, names.get("id", "")]))
    if not out and names and tag not in ("html", "body"):
        out = names.get("hidden", "until-found").lower() != "until-found" or names.get("aria-hidden", "").lower() == "true" or bool(NONE.search(names.get("style", "")))
    return Element(tag, path, out, parent.linked or tag == "a", inside, parent)


def blocks(html: str, tags: bool = True):
    """Text blocks in page order, (text, element, linked characters), and how often each path opens.  Without `tags`
    no tag, role or class name says what is the article or not."""
    root = Element("", 0, False, False, False, None)
    stack, counts, found = [root], {}, []
    open_: dict[str, int] = {}

    def close_from(k):
        for e in stack[k:]:
            open_[e.tag] -= 1
        del stack[k:]

    words: list[str] = []
    linked, at, n = 0, 0, len(html)

    def end():
        nonlocal linked
        if words:
            text = BLANK.sub(" ", unescape("".join(words))).strip()
            if text:
                found.append((text, stack[-1].block, linked))
            words.clear()
        linked = 0

    while at < n:
        m = TAG.search(html, at)
        begin = m.start() if m else n
        if begin > at and not stack[-1].out:
            words.append(html[at:begin])
            if stack[-1].linked:
                linked += begin - at
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            close = html.find("-->", at)
            at = n if close < 0 else close + 3
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                end()
            for k in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                if stack[k].tag == tag:
                    close_from(k)
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = close.end() if close else n
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                end()
            continue
        if tag in BLOCK:
            end()
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, an item an open item
                if stack[k].tag == "p" or stack[k].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th"):
                    close_from(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        new = _open(stack[-1], tag, m[3], tags)
        stack.append(new)
        open_[tag] = open_.get(tag, 0) + 1
        if tag in BLOCK:
            counts[new.path] = counts.get(new.path, 0) + 1
    end()
    return found, counts


def host_of(url):
    """Lower-case host of a URL column; null or odd URLs share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _occurrences(tags: bool):
    """(host, page, path, n, chars, linked, inside, text, above) of every page: how often a path opens, the
    unlinked and linked characters of the texts right in it, and their hash.  Path 0 is the page."""

    def run(batches):
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not html:
                    continue
                found, counts = blocks(html, tags)
                page = _name(html)
                text: dict[int, list] = {}
                for t, e, linked in found:
                    if not e.out:
                        text.setdefault(e.path, []).append((t, e, min(linked, len(t))))
                for path in {0} | counts.keys() | text.keys():
                    own = text.get(path, ())
                    links = sum(k for _, _, k in own)
                    rows.append((host, page, path, counts.get(path, 1), sum(len(t) for t, _, _ in own) - links, links, any(e.inside for _, e, _ in own), _name("\n".join(t for t, _, _ in own)) if own else 0, [0, *own[0][1].above()] if own else []))
            columns = list(zip(*rows)) or [()] * 9
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "page", "path", "n", "chars", "linked", "inside", "text", "above"])

    return run


def main_slots(pages: DataFrame, support: float = SUPPORT, tags: bool = True) -> DataFrame:
    """(host, slots, keeps): the template elements of a host that have text right in them, and whether that is
    of the article.

    pages: host, html.  Equal pages of a host count once.  All aggregations over pages have partial sums: a host with
    very many pages is no task of its own.
    """
    seen = pages.mapInArrow(_occurrences(tags), "host string, page bigint, path bigint, n int, chars bigint, linked bigint, inside boolean, text bigint, above array<bigint>")
    once = seen.groupBy("host", "page", "path").agg(*(F.first(c).alias(c) for c in ("n", "chars", "linked", "inside", "text", "above")))
    # the occurrence vector of a path, folded to a sum of hashes over pages
    vectors = cut(
        once.groupBy("host", "path").agg(
            F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"),
            F.count("*").alias("support"),
            F.max("n").alias("most"),
            F.sum("chars").alias("chars"),
            F.sum("linked").alias("linked"),
            F.max("inside").alias("inside"),
            F.min("text").alias("low"),
            F.max("text").alias("high"),
            F.count_distinct("text").alias("different"),
            F.max("above").alias("above"),
        )
    )
    classes = vectors.groupBy("host", "vector").agg(F.max("support").alias("stands"), F.max("most").alias("most"), F.collect_list("path").alias("paths"))
    pages_of = vectors.where("path = 0").select("host", F.col("support").alias("pages"))
    # an element's opening and closing make two tokens, so every class of a path is large enough
    template = classes.join(pages_of, "host").where((F.col("most") == 1) & (F.col("stands") >= support * F.col("pages"))).select("host", "pages", "stands", F.explode("paths").alias("slot"))
    texts = vectors.where("chars + linked > 0").select("host", "path", "support", "chars", "linked", "inside", "low", "high", "different", "above", F.posexplode("above").alias("depth", "slot"))
    around = cut(texts.join(template, ["host", "slot"]))
    values = ("slot", "pages", "stands", "support", "chars", "linked", "inside", "low", "high", "different", "above")
    inner = around.groupBy("host", "path").agg(F.max_by(F.struct(*values), "depth").alias("t")).select("host", "path", "t.*")
    # a text that all pages of its slot share belongs to the template
    varies = (F.col("stands") == 1) | (F.col("support") < F.col("stands")) | (F.col("low") != F.col("high")) | (F.col("inside") & (F.col("stands") < FEW))
    inner = inner.withColumn("varies", varies).withColumn("own", F.col("different") >= OWN * F.col("support"))
    # the region: the deepest template element that holds nearly all of what varies and is not linked
    plain = inner.where(F.col("varies") & (F.col("linked") <= F.col("chars"))).select("host", "path")
    held = around.join(plain, ["host", "path"]).groupBy("host", "slot").agg(F.sum("chars").alias("held"), F.min("depth").alias("depth"))
    total = held.where("slot = 0").select("host", F.col("held").alias("total"))
    region = held.join(total, "host").where(F.col("held") >= REGION * F.col("total")).groupBy("host").agg(F.max_by("slot", "depth").alias("region"))
    placed = inner.join(region, "host", "left").withColumn("below", F.coalesce(F.array_contains("above", F.col("region")), F.lit(True)))
    slots = placed.groupBy("host", "slot").agg(
        F.max("pages").alias("pages"),
        F.max("varies").alias("varies"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        F.max("inside").alias("inside"),
        F.max("below").alias("below"),
        F.min(F.when(F.col("varies"), F.col("own"))).alias("own"),
    )
    stays = F.col("varies") & (F.col("inside") | ((F.col("below") | F.col("own")) & (F.col("linked") <= F.col("chars"))))
    of_host = slots.groupBy("host").agg(
        F.max("pages").alias("pages"),
        F.sum(F.when(F.col("inside"), F.col("chars")).otherwise(0)).alias("within"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("chars"))).alias("around"),
        F.collect_list(F.struct("slot", "inside", F.coalesce(stays, F.lit(False)).alias("keep"))).alias("s"),
    )
    # on a single page nothing can vary: an article element decides
    alone = (F.col("pages") == 1) & (F.col("within") > 0) & (F.col("within") * 4 >= F.col("around"))
    return of_host.select("host", F.col("s.slot").alias("slots"), F.when(alone, F.col("s.inside")).otherwise(F.col("s.keep")).alias("keeps"))


def _article(html: str | None, slots: dict[int, bool], tags: bool = True) -> str:
    if not html:
        return ""
    texts = [(t, e, k) for t, e, k in blocks(html, tags)[0] if not e.out]
    chosen = [x for x in texts if slots.get(next((p for p in reversed(x[1].above()) if p in slots), 0), False)]
    if chosen:
        return "\n\n".join(t for t, _, _ in chosen)
    if texts:
        inside = [x for x in texts if x[1].inside]
        enough = sum(len(t) for t, _, _ in inside) * 4 >= sum(len(t) - k for t, e, k in texts if not e.inside)
        chosen = inside if inside and enough else texts
    # no slot tells: mostly linked blocks go
    return "\n\n".join(t for t, e, k in chosen if k * 2 <= len(t) or e.inside or e.tag in HEADINGS or e.tag == "p")


def _extract(slots, tags):
    def run(batches):
        names, bounds, paths, keeps = slots.value if slots is not None else (None,) * 4
        for batch in batches:
            hosts = batch.column("_host").to_pylist()
            if names is None:
                given = [dict(zip(s or (), k or ())) for s, k in zip(batch.column("_slots").to_pylist(), batch.column("_keeps").to_pylist())]
            else:
                given = []
                for h in (_name(h) for h in hosts):
                    j = int(np.searchsorted(names, h))
                    a, b = (bounds[j], bounds[j + 1]) if j < len(names) and names[j] == h else (0, 0)
                    given.append(dict(zip(paths[a:b].tolist(), keeps[a:b].tolist())))
            texts = [_article(h, s, tags) for h, s in zip(batch.column("_html").to_pylist(), given)]
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(texts, pa.string())], ["_rest", "text"])

    return run


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", support: float = SUPPORT, to: str = "text", tags: bool = True) -> DataFrame:
    """The input's rows without the html, and `text` (or another name, `to`): the article's blocks joined by two \\n.
    An input column of that name gives way to it.  Without `tags` the templates alone decide.

    A null html is empty and has no text; a null url belongs to the empty host; repeated rows
    stay; equal pages do not vote twice; ties of depth cannot be (a path has one); a very long page is
    handled whole in one task; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rest = [c for c in pages.columns if c not in (html_col, to)]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest"), host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"))
    slots = cut(main_slots(rows.select(F.col("_host").alias("host"), F.col("_html").alias("html")), support, tags))
    schema = T.StructType([rows.schema["_rest"], T.StructField("text", T.StringType())])
    if (slots.agg(F.sum(F.size("slots"))).first()[0] or 0) <= SLOTS:
        got = slots.collect()
        got = sorted(((_name(r["host"]), r["slots"], r["keeps"]) for r in got), key=lambda x: x[0])
        bounds = np.cumsum([0] + [len(x[1]) for x in got])
        shared = spark.sparkContext.broadcast((np.array([x[0] for x in got], np.int64), bounds, np.array([p for x in got for p in x[1]], np.int64), np.array([k for x in got for k in x[2]], bool)))
        out = rows.mapInArrow(_extract(shared, tags), schema)
    else:
        out = rows.join(slots.select(F.col("host").alias("_host"), F.col("slots").alias("_slots"), F.col("keeps").alias("_keeps")), "_host", "left").mapInArrow(_extract(None, tags), schema)
    return out.select(*(F.col(f"_rest.`{c}`").alias(c) for c in rest), F.col("text").alias(to))


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))
