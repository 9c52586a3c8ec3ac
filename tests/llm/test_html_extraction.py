"""Reading pages, and deleting what recurs across the pages of a host."""

import html
import random
import re

import pytest

from textshield.llm.html_extraction import extract_main_text, host_of, recurring
from textshield.llm.markup import Page


def read(source):
    page = Page(source)
    gone = page.surroundings()
    return page.blocks(gone, page.articles(gone))


@pytest.mark.parametrize("source, blocks", [
    ("", []),
    ("plain &amp; text", ["plain & text"]),
    ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
    ("<p>a <b>b</b>c<br>d\n\t e</p>", ["a bc d e"]),
    ("<ul><li>one<li>two <ul><li>deep</ul>back</ul>", ["one", "two", "deep", "back"]),
    ("<table><tr><td>1<td>2<tr><th>3</table>z", ["1", "2", "3", "z"]),
    ("<p>x < y and 3<4 &lt;b&gt;&nbsp;&#x41;&#66;&eacute; &am", ["x < y and 3<4 <b> ABé &am"]),
    ("<p>cut <a href=\"x", ["cut"]),
    ("<p>cut <!-- never closed", ["cut"]),
    ("<p>a <a href=\"x>b</p><p>c</p>", ["a b", "c"]),
    ("<p title='a>b' data-x=\">\">t</p>", ["t"]),
    ("<script>if (a<b) {'</p>'}</SCRIPT >t<style>x</style><noscript>n</noscript>", ["t"]),
    ("<h1>T</h1><p>a<div class='Sidebar-Left'>s</div><footer>f</footer>", ["T", "a"]),
    ("<body class='has-sidebar'><div id=mainNav>n</div><div class='content widget'><h1>T</h1><p>x</div><div id=comments><p>c</div></body>", ["T", "x"]),
    ("<div>out</div><article><header><h1>T</h1></header><p>a</p><aside>s</aside><form>f</form><section class=comments><article class=comment>c</article></section></article>", ["T", "a"]),
    ("<form id=aspnet><main><p>in a form</p></main></form>", ["in a form"]),
    ("<header><h1>Site</h1></header><div class=cookieConsent>ok</div><p>body", ["body"]),
    ("<div role=navigation>n</div><div role=main><p>q</p></div><div>r</div>", ["q"]),
    ("<article>one</article><p>between</p><article>two</article>", ["one", "two"]),
    ("<div class='no-sidebar with_comments'><article class='post comments-open'><h2>T</h2><p>a</p><div class='comment-body'>c</div></article></div>", ["T", "a"]),
    ("<P>big</P><TITLE>t</TITLE><textarea><p>x</textarea>", ["big"]),
])
def test_blocks(source, blocks):
    assert read(source) == blocks


def test_hostile_pages_take_little_time():
    for source in ("<b>" * 100_000 + "</i>" * 100_000, "<div>" * 100_000 + "<li>x" * 50_000, "<a b=\"" * 20_000, "<!--" * 50_000, "<" * 200_000, "&" * 200_000):
        read(source)


def test_hosts(spark):
    urls = ["http://A.example.org/x", "https://u:p@b.example:8080?q", "//c.example#t", "no address", None, "ftp://d.example"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in frame.select(host_of(frame["url"])).collect()] == ["a.example.org", "b.example", "c.example", "", "", "d.example"]


@pytest.fixture(scope="module")
def pages():
    """Unlabelled templates on two hosts, copies of a page, and paragraphs that authors repeat."""
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice("one two three four five six seven eight nine ten".split()) + str(rng.randint(0, 999)) for _ in range(n))
    out, want = [], []
    box = "<div><span>read all our other great stories today</span><i>and more of them</i></div>"
    for i in range(40):
        texts = [line(20), line(12), "Of.", "all of this may be copied by anyone"]
        body = "".join(f"<p>{t}</p>" for t in texts)
        if i % 2:
            out.append((i, f"http://a.example/{i}", f"<body><div>the unlabelled menu of the site a</div>{body[:40]}{body[40:]}{box}</body>"))
            want.append(texts[:3])
        else:
            out.append((i, f"http://b.example/{i}", f"<body><article>{body}{box}</article></body>"))
            want.append(texts)
    copy = "".join(f"<p>{line(9)}</p>" for _ in range(3))
    for i in range(40, 50):
        out.append((i, "http://c.example/", f"<body>{copy}</body>"))
        want.append(re.findall("<p>(.*?)</p>", copy))
    return out, ["\n\n".join(w) for w in want]


def test_templates_go_and_copies_stay(spark, pages):
    rows, want = pages
    frame = spark.createDataFrame([(*r, "kept", 7) for r in rows], "page_id long, url string, html string, TEXT string, host int").repartition(5)
    got = sorted(map(tuple, extract_main_text(frame).collect()))
    assert [(r[0], r[4]) for r in got] == [(i, t) for i, t in enumerate(want)]
    assert all(r[5] == len(r[4]) and r[3] == 7 for r in got)
    assert recurring(frame).count() == 6
    # the same by a join, as if there were too many hashes to send to every task
    assert sorted(map(tuple, extract_main_text(frame, broadcast=2).collect())) == got


def test_pages_against_their_articles(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in extract_main_text(frame).collect()}
    for r in frame.collect():
        article = re.search("<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", article)]
        assert texts[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_nulls_copies_and_long_pages(spark):
    long = "<p>" + "word " * 400_000 + "</p>"
    rows = [(1, None, None), (1, None, None), (None, "http://x.example", ""), (2, "http://x.example", long), (3, None, "<p>a</p>"), (3, None, "<p>a</p>")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 1_999_999), (3, 1), (3, 1)]
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
