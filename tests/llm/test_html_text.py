from collections import Counter, defaultdict

from terrasol.llm import html_text as H
from terrasol.llm.html_text import blocks, extract, main_slots, op4_html_text
from tests.conftest import DATA

PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><script>var t="</p>";</script><style>p{{}}</style></head><body class="has-sidebar">
<nav><ul><li><a href="/x">menu{n}</a></li></ul></nav><div class="ad">buy{n}</div><div id="cookie-notice">we use cookies</div>
{open}<h1>Head {n} &amp; more</h1><p>First   paragraph\n{n} of &eacute;t&#233; <b>bold</b>.</p><p>Second {n}<br>line</p><div class="comments"><p>nice{n}</p></div><form><p>mail</p></form>{close}
<aside>side{n}</aside><footer>&copy; foot{n}</footer></body></html>"""


def want(n):
    return f"Head {n} & more\n\nFirst paragraph {n} of été bold.\n\nSecond {n} line"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_element(spark):
    rows = [(i, "https://h.example/a", PAGE.format(n=i, open="<article>", close="</article>")) for i in range(3)]
    got = {r.page_id: r.text for r in extract(frame(spark, rows)).collect()}
    assert got == {i: want(i) for i in range(3)}


def test_slot_of_a_host_without_article(spark):
    rows = [(i, "https://h.example/a", PAGE.format(n=i, open='<div class="k3">', close="</div>")) for i in range(6)]
    rows += [(100, "https://alone.example/", PAGE.format(n=100, open='<div class="zz">', close="</div>"))]
    got = {r.page_id: r.text for r in extract(frame(spark, rows)).collect()}
    assert got == {i: want(i) for i in (*range(6), 100)}


def test_all_varying_slots_of_a_host_without_article(spark):
    page = '<html><body><div class="strip">Skip the line and come in, dear reader, all of you are welcome here, always and at any time of the day</div><div class="post"><h1>Title {n}</h1><div class="lead">Lead {n}</div><div class="body"><p>First {n}<p>Second {n}</div></div></body></html>'
    got = {r.page_id: r.text for r in extract(frame(spark, [(i, "https://h.example/a", page.format(n=i)) for i in range(6)])).collect()}
    assert got == {i: f"Title {i}\n\nLead {i}\n\nFirst {i}\n\nSecond {i}" for i in range(6)}


def test_template_decides_on_pages_with_article(spark):
    page = '<html><body><h1>Title {n}</h1><article><p>Text {n}<p>More {n}<div class="k1">Set in Garamond by the house</div></article></body></html>'
    got = {r.page_id: r.text for r in extract(frame(spark, [(i, "https://h.example/a", page.format(n=i)) for i in range(6)])).collect()}
    assert got == {i: f"Title {i}\n\nText {i}\n\nMore {i}" for i in range(6)}


def test_joined_slots_equal_sent_slots(spark, monkeypatch):
    rows = [(i, f"https://h{i % 3}.example/a", PAGE.format(n=i, open='<div class="k3">', close="</div>")) for i in range(9)]
    sent = sorted(extract(frame(spark, rows)).collect())
    monkeypatch.setattr("terrasol.llm.html_text.SLOTS", 0)
    assert sorted(extract(frame(spark, rows)).collect()) == sent and sent[0].text == want(0)


def test_edges(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/", "<p>a < b &lt; c"), (3, "http://h/", "<p>a < b &lt; c"), (None, None, "plain"), (5, "http://h/", "<article><p>" + "word " * 50_000 + "</article>"), (6, "http://h", "<script>never closed <p>x"), (7, "http://h", "<article><p>one<p>two<ul><li>three<li>four</ul>")]
    got = sorted(((r.page_id, r.text) for r in extract(frame(spark, rows)).collect()), key=str)
    by = {}
    for p, t in got:
        by.setdefault(p, []).append(t)
    assert by[1] == [""] and by[2] == [""] and by[3] == ["a < b < c"] * 2 and by[None] == ["plain"] and by[6] == [""]
    assert by[7] == ["one\n\ntwo\n\nthree\n\nfour"] and len(by[5][0]) == 249_999
    assert extract(frame(spark, [])).count() == 0


def test_query_leaves_out_what_is_around(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect()}
    for r in op4_html_text(spark, f"{DATA}/sf0.001").collect():
        assert r.n_chars == len(r.text) and "©" not in r.text and "track(" not in r.text
        assert ("<article>" not in html[r.page_id]) or r.text


def test_only_whole_names_and_attributes_take_parts_out(spark):
    page = '<html><body><div class="overflow-hidden x" data-note="hidden"><article><p>Text {n}<div class="social-policy">Policy {n}</div><div class="ad-box">buy {n}</div><p hidden>unseen {n}<p style="display: none">gone {n}</article></div></body></html>'
    got = {r.page_id: r.text for r in extract(frame(spark, [(i, "https://h.example/a", page.format(n=i)) for i in range(6)])).collect()}
    assert got == {i: f"Text {i}\n\nPolicy {i}" for i in range(6)}


def test_unclosed_tags():
    found, counts = blocks("<font>" * 50_000 + "text<p>para</b></font>" + "<div>" * 3_000 + "deep")
    assert [t for t, _, _ in found] == ["text", "para", "deep"] and len(found[2][1].above()) <= 513


def test_a_column_called_as_the_result_gives_way(spark):
    rows = spark.createDataFrame([(1, "http://h/", "<p>one", "old")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in extract(rows).select("page_id", "text").collect()] == [(1, "one")]
    assert [tuple(r) for r in extract(rows, to="article").select("text", "article").collect()] == [("old", "one")]


def slots_of(pages, tags=True):
    """Classes, slots and region of one host's different pages by their definition, on whole occurrence vectors."""
    pages = sorted({p for p in pages if p})
    vector, own, above = defaultdict(lambda: [0] * len(pages)), defaultdict(dict), {}
    for k, html in enumerate(pages):
        found, counts = blocks(html, tags)
        vector[0][k] = 1
        for path, n in counts.items():
            vector[path][k] = n
        for text, e, linked in found:
            if not e.out:
                vector[e.path][k] = vector[e.path][k] or 1
                own[e.path].setdefault(k, []).append((text, min(linked, len(text)), e.inside))
                above[e.path] = [0, *e.above()]
    stands = {p: sum(n > 0 for n in v) for p, v in vector.items()}
    template = {p for p, v in vector.items() if max(v) == 1 and stands[p] >= H.SUPPORT * len(pages)}
    facts = {}
    for path, texts in own.items():
        slot = next(p for p in reversed(above[path]) if p in template)
        joined = [tuple(t for t, _, _ in texts[k]) if k in texts else () for k in range(len(pages)) if vector[path][k]]
        inside = any(i for x in texts.values() for _, _, i in x)
        linked = sum(k for x in texts.values() for _, k, _ in x)
        chars = sum(len(t) for x in texts.values() for t, _, _ in x) - linked
        varies = stands[slot] == 1 or stands[path] < stands[slot] or len(set(joined)) > 1 or inside and stands[slot] < H.FEW
        facts[path] = (slot, chars, linked, inside, varies, len(set(joined)) >= H.OWN * stands[path])
    held = Counter()
    for path, (_, chars, linked, _, varies, _) in facts.items():
        if varies and linked <= chars:
            held.update({p: chars for p in above[path] if p in template})
    depth = {p: d for a in above.values() for d, p in enumerate(a)}
    region = max((p for p in held if held[p] >= H.REGION * held[0]), key=depth.get, default=0)
    keep = {}
    for slot in {f[0] for f in facts.values()}:
        of = [(p, f) for p, f in facts.items() if f[0] == slot]
        moves = [f[5] for _, f in of if f[4]]
        placed = any(region in above[p] for p, _ in of) or bool(moves) and all(moves)
        few_links = sum(f[2] for _, f in of) <= sum(f[1] for _, f in of)
        keep[slot] = bool(moves) and (any(f[3] for _, f in of) or placed and few_links)
    return keep


def test_slots_equal_the_definition_on_whole_vectors(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").select(H.host_of("url").alias("host"), "html").collect()
    hosts = defaultdict(list)
    for r in rows:
        hosts[r.host].append(r.html)
    chosen = sorted((h for h in hosts if len(hosts[h]) > 3), key=lambda h: (-len(hosts[h]), h))[:12]
    extra = '<html><body><div class="strip">Skip</div><div class="g{g}"><h1>Title {n}</h1><div class="lead">Lead {n}</div><div class="body"><p>First {n} and more of it here<p>Second {n}</div></div><div class="foot">{m} of us</div></body></html>'
    hosts["extra"] = [extra.format(n=n, m=n % 3, g=n % 8 == 0) for n in range(40)] + [""]
    data = spark.createDataFrame([(h, p) for h in (*chosen, "extra") for p in hosts[h] * 2], "host string, html string").repartition(3)
    for tags in (True, False):
        got = {r["host"]: dict(zip(r["slots"], r["keeps"])) for r in main_slots(data, tags=tags).collect()}
        want = {h: slots_of(hosts[h], tags) for h in (*chosen, "extra")}
        assert got == want and any(k for s in want.values() for k in s.values()) and not all(k for s in want.values() for k in s.values())


def test_templates_alone(spark):
    """Without tags, roles, class names and article elements: 2,457 of 2,500 pages equal, 0.09 % of characters too many."""
    pages = spark.read.parquet(f"{DATA}/sf0.1/pages.parquet")
    want = {r.page_id: r.text for r in op4_html_text(spark, f"{DATA}/sf0.1").collect()}
    got = {r.page_id: r.text for r in extract(pages, tags=False).select("page_id", "text").collect()}
    assert sum(got[k] == t for k, t in want.items()) > 0.95 * len(want)
    assert sum(max(0, len(got[k]) - len(t)) for k, t in want.items()) < 0.002 * sum(map(len, want.values()))
    assert all(len(got[k]) >= len(t) for k, t in want.items())


def test_notices_beside_an_article_of_plain_elements(spark):
    first, more = "Text {n} of this page, " + "long enough to weigh much more than all that stands around it, " * 3 + "and on", "More {n} of it, and some words"
    page = '<html><body><div class="q1">Buy {m} now, cheap</div><div class="q2"><h2>Title {n}</h2><div class="q3"><p>' + first + "</p><p>" + more + '</p></div></div><div class="q4">Printed in {m} towns</div></body></html>'
    rows = [(i, "https://h.example/a", page.format(n=i, m=i % 4)) for i in range(24)]
    got = {r.page_id: r.text for r in extract(frame(spark, rows)).collect()}
    assert got == {i: f"Title {i}\n\n{first.format(n=i)}\n\n{more.format(n=i)}" for i in range(24)}
