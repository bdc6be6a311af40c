"""Extraction: the rules on made-up pages, the table against its article."""

import html
import re

from windlass.llm import html_extract
from windlass.llm.html_extract import Page, extract, templates


def text(source):
    return Page(source).main_text()


def test_article_only():
    assert text('<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
                '<header>Site</header><nav><ul><li><a href=x>A</a></li></ul></nav><!-- no -->'
                '<div class="ad">Buy</div><article class="post"><h1>H &amp; K</h1><p><b>One\n two<br>three<p>Four'
                '<div class="share">s</div><form>f</form><section id="comments"><article>c</article></section>'
                '</article><aside>x</aside><footer>&copy;</footer>') == "H & K\n\nOne two three\n\nFour"


def test_no_article_and_damage():
    assert text("<p>a<p>b<ul><li>c<li>d</ul>e") == "a\n\nb\n\nc\n\nd\n\ne"
    assert text("") == text("<script>x") == text("<!-- x") == ""
    assert text("a < b &lt; c <p>1 <i>2</i>3</p") == "a < b < c\n\n1 23"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3"
    assert text("<div role=navigation>n</div><p>x</p><div class='cookie-notice'>y</div>") == "x"
    assert text('<p title="a>b">x</p>') == "x"
    assert len(text("<p>x " * 50_000)) == 50_000 + 2 * 49_999


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")


def test_templates_are_removed_per_host(spark):
    rows = []
    for i in range(10):
        rows.append((i, "http://a.com/x", f"<body><div class=x><p>Welcome to our site</p></div><p>Story {i}</p></body>"))
        rows.append((100 + i, f"http://b{i}.com/", f"<body><div class=x><p>Welcome to our site</p></div><p>S {i}</p></body>"))
    rows += [(300 + i, "http://c.com/", "<body><div><p>The same page</p></div></body>") for i in range(30)]
    rows += [(400 + i, "http://d.com/", f"<article><p>Shared sentence</p><p>{i}</p></article>") for i in range(9)]
    rows += [(None, None, None), (500, "x", ""), (500, "x", "")]
    got = {}
    for r in extract(pages(spark, rows)).collect():
        got[r.page_id] = r.text
        assert r.n_chars == len(r.text)
    assert got[3] == "Story 3" and got[104] == "Welcome to our site\n\nS 4"
    assert got[305] == "The same page" and got[404] == "Shared sentence\n\n4"
    assert got[None] == got[500] == ""
    assert extract(pages(spark, rows)).count() == len(rows)
    assert extract(pages(spark, rows).limit(0)).count() == 0
    nodes = pages(spark, rows[:20]).selectExpr("split(url, '/')[2] host", "page_id page", "html").mapInArrow(
        html_extract._subtrees, html_extract._NODES)
    assert {r.host for r in templates(nodes).collect()} == {"a.com"}


BOX = "<div class=x7><h3>Join the club</h3><p>Members read more.</p><ul><li>Now</li></ul></div>"


def site(host, pages_, article):
    return [(i, f"http://{host}/{i}", f"<html><body><main>{article(i)}</main></body></html>") for i in range(pages_)]


def test_boxes_inside_articles_are_templates(spark, monkeypatch):
    """A box without a telling name that recurs in different articles goes, by
    share of a small host, by count on a large one; prose that recurs stays, and
    so does an article that stands on many pages, however it is wrapped."""
    story = lambda i: f"<p>Story {i} goes on and on, long enough to be most of it.</p><p>Shared sentence.</p>"
    rows = site("small.com", 8, lambda i: story(i) + BOX)
    rows += site("large.com", 400, lambda i: story(i) + (BOX if i % 10 == 0 else "<div><p>x</p></div>" if i % 100 == 1 else ""))
    rows += [(i, u, h) for i, u, h in site("copies.com", 40, lambda i: "<div><p>One article, on many pages.</p></div>")]
    rows = [(k, u, h.replace("</body>", f"<p>{i}</p></body>") if "copies" in u else h) for k, (i, u, h) in enumerate(rows)]
    rows += site("half.com", 40, lambda i: f"<h1>{i}</h1><div><p>The body of the story, the same under other titles.</p></div>")
    df = pages(spark, rows)
    want = []
    for i, u, h in rows:
        page = Page(h)
        text = page.main_text()
        if "small" in u or "large" in u:
            text = text.replace("\n\nJoin the club\n\nMembers read more.\n\nNow", "")
        want.append((i, text))
    plain_texts = [(i, Page(h).main_text()) for i, _, h in rows]
    assert sum(a != b for a, b in zip(want, plain_texts)) == 48
    for bound in (html_extract.BROADCAST_TEMPLATES, 0):
        monkeypatch.setattr(html_extract, "BROADCAST_TEMPLATES", bound)
        assert sorted((r.page_id, r.text) for r in extract(df).collect()) == sorted(want)


def plain(source):
    """The article of the table's pages, by their known markup."""
    m = re.search("<article>(.*?)(?:</article>|$)", source, re.S)
    parts = re.split("<p>|</p>|<h1>|</h1>", m[1]) if m else []
    out = [" ".join(html.unescape(re.sub("<[^>]*>", lambda t: " " if t[0].startswith("<br") else "", x)).split())
           for x in parts]
    return "\n\n".join(x for x in out if x)


def test_table(spark):
    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(p).collect()}
    rows = p.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id] == plain(r.html), r.page_id
