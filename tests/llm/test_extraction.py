"""Articles out of pages of many makes, densities against their formula, and corner cases."""

import html
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import types as T

from docweave.llm import extraction as ex

P1, P2 = "The first paragraph tells of a town by the sea, and of its people. " * 3, "A second paragraph goes on & ends it all, with 5 < 6 words. " * 4
E1, E2 = html.escape(P1), html.escape(P2)
WANT = " ".join(f"A title {P1} {P2}".split())
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(8)) + "</ul>"

PAGES = {
    "semantic": f"<html><body><header><h1>Site</h1></header><nav>{MENU}</nav><main><article><h1>A title</h1><p>{E1}</p><p>{E2}</p></article></main><footer>&copy; 2020</footer></body></html>",
    "plain divs": f'<body><div id="header">Site name</div><div class="main-menu">{MENU}</div><div id="content"><h1>A title</h1><div class="text"><p>{E1}</p><p>{E2}</p></div></div><div class="sidebar"><p>{E1}</p></div><div id="footer">Imprint</div></body>',
    "unclosed": f"<body><div class=ad>Buy {E2}</div><article><h1>A title</h1><p><b>{E1}<br><p>{E2}",
    "comments": f'<body><article><h1>A title</h1><p>{E1}</p><p>{E2}</p><section class="comments"><article><p>Nice {E1}</p></article></section></article></body>',
    "notices": f'<body><div class="cookie-notice">We use cookies. {E1}</div><article><h1>A title</h1><p>{E1}</p><aside>{E2}</aside><p>{E2}</p><form><p>Your mail {E1}</p></form></article><div hidden>{E1}</div></body>',
    "scripts": f'<head><title>A title</title><style>p{{margin:0}}</style></head><body><script>var t="</p><p>";if(a<b)c()</script><article><!-- <p>old</p> --><h1>A title</h1><p>{E1}</p><script>x</script><p>{E2}</p></article></body>',
    "inline": f"<body><article><h1>A <em>ti</em>tle</h1><p>{E1.replace('town', '<a href=x>to<b>wn</b></a>', 1)}</p>\n\n <p>  {E2.replace(' ', chr(10) + chr(9))} </p></article></body>",
    "wrapped": f'<body><div id="wrap"><div class="menu">{MENU}</div><div class="post"><h1>A title</h1><div><p>{E1}</p><p>{E2}</p></div></div></div></body>',
}


@pytest.mark.parametrize("name", PAGES)
def test_articles(name):
    assert ex.main_text(PAGES[name]) == WANT


def test_references_and_void_elements():
    assert ex.main_text("<article><p>a&amp;b &eacute;&#233;&#x1F937; &nbsp;x<br>y<img src='>'>z</p></article>") == "a&b éé\U0001f937 x yz"
    assert ex.main_text("no tags at all") == "no tags at all"
    assert ex.main_text("<p>short</p>") == "short"
    assert ex.main_text('<div class="ad"><p>all of it is marked</p></div>') == "all of it is marked"


def test_density_formula():
    root = ex.parse("<div><p>abcdefgh</p><p>ij<a>kl</a></p></div>")
    ex.measure(root)
    div = root.children[0]
    assert (div.chars, div.tags, div.link_chars, div.link_tags) == (12, 3, 2, 1)
    assert abs(div.sum - sum(p.density for p in div.children)) < 1e-9
    assert div.children[0].density > div.children[1].density


def test_no_page_breaks_it():
    rnd = random.Random(4)
    parts = ["<p>", "</p>", "<div", ">", "<", "'", '"', "text ", "<!--", "-->", "<script>", "</script>", "<li>", "<td>", "</table>", "&amp", "<a href='", "é", "<b/>", "</"]
    for _ in range(2000):
        out = ex.main_text("".join(rnd.choice(parts) for _ in range(rnd.randrange(30))))
        assert out == " ".join(out.split())
    assert ex.main_text("<div>" * 50_000 + "deep") == "deep"
    assert ex.main_text("<a " * 20_000) == " ".join(("<a " * 20_000).split())


def test_table_of_pages(spark):
    sf = "/root/testdata/sf0.01"
    rows = ex.extract(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "url", "text", "n_chars").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|<footer>|$)", pages[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", re.sub(r"<!--.*?-->", "", inside, flags=re.S)))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


def test_corner_cases(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("TEXT", T.StringType())])
    df = spark.createDataFrame([(1, None, None, "clash"), (None, "u", "", None), (2, "u", "<p>x", None), (2, "u", "<p>x", None)], schema)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in ex.extract(df).collect()) == [(0, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert ex.extract(df.where("false")).collect() == []


#: No element or name tells the article from the rest.
UNNAMED = f"""<body><div><div>Harbour Gazette</div><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/w>Weather</a></li></ul></div>
<div><div><h1>A title</h1><div><p>{E1}</p><p>Yes.</p><p>{E2}</p></div></div><div><div><a href=1>One more</a></div><div><a href=2>Another story</a></div><div><a href=3>And a third</a></div></div></div>
<div><div>Imprint</div><div><a href=/c>Contact</a></div></div></body>"""


def test_a_page_without_names_is_decided_by_density():
    assert ex.main_text(UNNAMED) == " ".join(f"A title {P1} Yes. {P2}".split())


def table_pages():
    rows = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    return [r[0] for r in rows]


@pytest.mark.parametrize(("part", "instead"), [("select", lambda root: root), ("density", lambda *facts: 1.0), ("doubted", lambda *marks: False)])
def test_each_part_shapes_the_texts(monkeypatch, part, instead):
    """Taking what density selects, the densities themselves, and the words of doubt: without any one of them, most pages come out otherwise."""
    pages = table_pages()
    whole = [ex.main_text(p) for p in pages]
    monkeypatch.setattr(ex, part, instead)
    changed = sum(ex.main_text(p) != w for p, w in zip(pages, whole))
    assert changed >= (0.5 if part == "doubted" else 0.9) * len(pages)


#: Menus, comments and notices without any word that tells; the article is what has text enough.
PLAIN = f"""<body><div id="a1"><div id="b"><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div></div>
<div id="a2"><div id="c"><h1>A title</h1><p>{E1}</p><p>{E2}</p><p>{E1}</p></div>
<div id="d"><div><b>Ann</b> <a href=/r>says</a> <a href=/x>up</a> <a href=/y>down</a> <i>1</i> nice</div><div><b>Bob</b> <a href=/r>says</a> <a href=/x>up</a> <a href=/y>down</a> <i>2</i> so so</div></div></div>
<div id="a3"><span>Imprint</span> <a href=/c>Contact</a> <a href=/d>Terms</a></div></body>"""


def test_menus_and_comments_without_names_go_by_density():
    assert ex.main_text(PLAIN) == " ".join(f"A title {P1} {P2} {P1}".split())


def test_words_of_doubt_only_lower_a_density():
    page = f"<body><div class='content'><p>{E1}</p><p class='share'>{E2}</p></div></body>"
    assert ex.main_text(page) == " ".join(P1.split())
    all_doubted = f"<body><div class='share widget'><p>{E1}</p><p>{E2}</p></div></body>"
    assert ex.main_text(all_doubted) == " ".join(f"{P1} {P2}".split())


def test_hostile_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<div>" * 60_000 + "</span>" * 60_000 + "x", "<div>" * 60_000 + "<li>y" * 60_000, "<b>" * 60_000 + "<div>z</div>" * 60_000, "<td>" * 60_000, "<p>" + "<b>" * 60_000 + "<p>z" * 60_000):
        ex.parse(page)
    assert time.perf_counter() - began < 30


def plain_facts(node, outside=False):
    """(characters, tags, link characters, link tags) by the definition, each anew from the texts below."""
    if isinstance(node, str):
        return len(" ".join(node.split())), 0, 0, 0
    sums = [0, 0, 0, 0]
    for c in node.children:
        for i, x in enumerate(plain_facts(c, outside)):
            sums[i] += x
        sums[1] += not isinstance(c, str)
    if node.outside or node.doubted:
        return sums[0], sums[1], sums[0], sums[1] + 1
    return (sums[0], sums[1], sums[0], 1) if node.tag == "a" else tuple(sums)


def plain_density(facts, share):
    c, t, lc, lt = facts
    t = max(t, 1)
    if c == 0 or (lc >= c and lt >= t):
        return 0.0
    import math

    inner = c / max(c - lc, 1) * lc + share * c + math.e
    return c / t * math.log(max((c / max(lc, 1)) * (t / max(lt, 1)), 1)) / math.log(math.log(inner) + 1)


def test_sums_and_core_by_the_definition():
    rnd = random.Random(8)
    tags = ["div", "p", "ul", "li", "a", "b", "section", "article", 'div class="ad"', "h2"]
    for _ in range(300):
        page, open_ = [], []
        for _ in range(rnd.randrange(2, 40)):
            move = rnd.random()
            if move < 0.4:
                tag = rnd.choice(tags)
                page.append(f"<{tag}>")
                open_.append(tag.split()[0])
            elif move < 0.6 and open_:
                page.append(f"</{open_.pop()}>")
            else:
                page.append(" word" * rnd.randrange(1, 30))
        root = ex.parse("".join(page))
        ex.mark(root)
        ex.measure(root)
        whole = plain_facts(root)
        share = whole[2] / max(whole[0], 1)
        nodes, sums, depths = ex.in_order(root), [], []
        for n in nodes:
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == plain_facts(n)
            assert abs(n.density - plain_density(plain_facts(n), share)) < 1e-9
            own = sum(len(" ".join(c.split())) for c in n.children if isinstance(c, str))
            total = 0.0 if n.outside or n.doubted else plain_density((own, 1, 0, 0), share)
            for c in n.children:
                total += 0.0 if isinstance(c, str) else plain_density(plain_facts(c), share)
            assert abs(n.sum - total) < 1e-9
            sums.append(n.sum)
            depth, up = 0, n
            while up.parent is not None:
                depth, up = depth + 1, up.parent
            depths.append(depth)
        best = max(range(len(nodes)), key=lambda i: (sums[i], depths[i], -i))
        assert ex.core_of(root) is nodes[best]


def test_the_threshold_of_the_path_decides_neighbours():
    root = ex.parse(f"<body><div><p>{E1}</p><p>{E2}</p></div><div><i>few</i><i>words</i><i>many</i><i>tags</i></div><section><p>{E2}</p></section></body>")
    ex.mark(root)
    ex.measure(root)
    body = root.children[0]
    core = ex.core_of(root)
    least = min(core.density, body.density)
    kept = [c for c in body.children if c is core or c.density >= least]
    assert ex.select(root).children == kept and len(kept) == 2


def test_very_long_page(spark):
    page = "<body><nav><a>x</a></nav><article>" + "<p>word word word</p>" * 100_000 + "</article></body>"
    row = ex.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert row.n_chars == 15 * 100_000 - 1
