"""Main text of pages: parsing, host templates, edges."""

import html
import random
import re

from cotopic.llm.pagetemplate import host_of, in_order, main_text, main_texts, page_structure, parse, templates
from pyspark.sql import functions as F


def test_parts_around_the_article_go():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
    <body class="nav-open"><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li>More</ul></nav>
    <div class="cookie-notice">We use cookies</div><main><article><h1>A  title</h1><p>One &amp; two&nbsp;three<br>four
    <p>Five <b>six</b>seven<!-- no --><aside>Side</aside><div class=ad>Buy</div><form><p>Name</p></form>
    <blockquote>a < b &lt;p&gt;</blockquote><section id="comments"><article class="comment"><p>First!</p></article></section>
    <p hidden>gone</p><p style="display: none">gone</p><noscript>gone</noscript></article></main>
    <footer>&copy; Site</footer></body></html>"""
    assert main_text(page) == "A title\nOne & two three four\nFive sixseven\na < b <p>"


def test_odd_pages():
    assert main_text("") == main_text("<") * 0 == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<article>open <p>ended") == "open\nended"
    assert main_text("<article>x<!-- never closed <p>y") == "x"
    assert main_text("<article><p>a<script>never closed <p>y") == "a"
    assert main_text("</p></div><article>a</nav></b><p>b</article>c") == "a\nb"
    assert main_text('<article><p title="a > b" data-x=\'>\'>t</p></article>') == "t"
    assert main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert main_text("<article><p>" + "w " * 500_000).count("w") == 500_000
    assert main_text("<ARTICLE><P>é x &#233; &nosuch; &notin;</P></ARTICLE>") == "é x é &nosuch; ∉"


def test_blocks_have_the_paths_of_their_elements():
    tokens, blocks = parse('<body><div class="post 12"><p>x<p>y</div><ul><li>a<li>b<ul><li>c</ul></ul>')
    assert [(b.element.path, b.text) for b in blocks] == [
        ("/body/div.post 0/p", "x"), ("/body/div.post 0/p", "y"), ("/body/ul/li", "a"), ("/body/ul/li", "b"), ("/body/ul/li/ul/li", "c")]


def test_order_and_nesting():
    assert in_order([[0], [3], [5]]) == [True] * 3
    assert in_order([[0], [9], [5], [7]]) == [True, False, True, True]
    assert in_order([[0, 4], [1, 5], [2, 6]]) == [True] * 3
    assert in_order([[0, 4], [1, 9], [2, 6]]) == [True, True, False]  # the later of two that disagree
    classes = {1: (7, 0), 2: (7, 1), 3: (7, 2), 4: (8, 0), 5: (8, 1)}
    rows = page_structure([1, 4, 5, 4, 5, 2, 3], classes, {7: 3, 8: 2})
    assert {(c, s is not None) for c, t, s in rows if t is None} == {(7, True), (8, True)}
    assert len([r for r in rows if r[0] == 8]) == 1  # both occurrences stand in one slot
    assert len([r for r in page_structure([1, 4, 5, 2, 4, 5, 3], classes, {7: 3, 8: 2}) if r[0] == 8]) == 2


def sites(seed=1):
    """Pages of hosts without article tags: what is chrome shows only across pages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, want = [], {}
    for i in range(120):
        host = ["a.example", "b.example", "c.example"][0 if i % 3 else (i // 3) % 3]
        paras = [" ".join(rng.sample(words, rng.randrange(5, 30))) for _ in range(rng.randrange(1, 6))]
        items = "".join(f"<li><a href='/{k}'>{rng.choice(words)}</a></li>" for k in range(rng.randrange(1, 7)))
        page = (f"<html><body><div id=top><div>Welcome to {host}</div><div>All the news</div></div><ul>{items}</ul>"
                f"<div class=body>{''.join(f'<p>{p}</p>' for p in paras)}</div><div id=end><p>Terms</p><p>Privacy &amp; you</p></div></body></html>")
        rows.append((i, f"https://{host.upper()}:8080/p/{i}?q=1", page))
        want[i] = "\n".join(paras)
    return rows, want


def test_templates_of_hosts(spark):
    rows, want = sites()
    rows += [(900, None, "<p>Terms</p>"), (901, "no host", None), (902, "https://few.example/1", "<div id=end><p>Terms</p></div>"), (903, "http:///x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("_row", F.lit(2))
    out = {r.page_id: r for r in main_texts(df).collect()}
    assert {i: out[i].text for i in want} == want
    assert all(r.n_chars == len(r.text) and r["_row"] == 2 for r in out.values())
    assert (out[900].text, out[901].text, out[902].text, out[903].text) == ("Terms", "", "Terms", "")
    texts, hot = templates(df)
    assert {r.host for r in texts.where("size(texts) >= 4").collect()} == {"a.example", "b.example", "c.example"}
    assert hot.count() <= 1000 and main_texts(df.limit(0)).count() == 0


def test_copies_of_an_article_are_kept(spark):
    """An article that most pages of a host show is still its main text."""
    page = "<html><body><nav><a href=/>x{0}</a></nav><article><h1>Same</h1><p>every time</p><p>again</p></article><footer>f</footer></body></html>"
    rows = [(i, "http://h.example/", page.format(i)) for i in range(30)] + [(30, "http://h.example/", page.format(0))] * 3
    out = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 33 and {r.text for r in out} == {"Same\nevery time\nagain"}


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in main_texts(pages).collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks]
        assert r.text == "\n".join(b for b in blocks if b)


def test_hosts(spark):
    urls = ["http://A.example/x", "https://u:p@b.example:80", "//c.example?q", "mailto:x@y", "", None, "  ftp://d.example#f"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(host_of(F.col("url"))).collect()] == ["a.example", "b.example", "c.example", None, None, None, "d.example"]
