import html as H
import re
import time
import tracemalloc

import duckdb

from loomstone.llm import html as X


def test_whole_table(spark, small):
    """The pages of the fixture all hold one article; a plain reading of it is the check."""
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{small}/pages.parquet'").fetchall()
    want = []
    for page_id, url, page in rows:
        article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", " ", part)).split()) for part in re.split(r"</?(?:h1|p)>", article)]
        text = "\n".join(b for b in blocks if b)
        want.append((page_id, url, text, len(text)))
    assert sorted(map(tuple, X.op1_html(spark, small).collect())) == sorted(want)


PAGE = """<!DOCTYPE html><html><body class="no-sidebar"><header>Site <h1>Name</h1></header><nav><a href=/>One</a></nav>
<div class="post-17 content"><h1>Title &amp; more</h1>Lead text, loose<p>Para one, with <a href='x>y'>link</a> text&nbsp;here.<p>Para two,
 &lt;etc&gt;&#46;<br>Next<!-- no --><script>var a = "</p>";</script><div class="ad-box">Buy</div><ul><li>x, y<li>z</ul></div>
<div id=comments><p>nice, really nice comment, wow, very long indeed, ok, yes</p></div><form><p>mail</p></form><footer>f</footer>"""
TEXT = "Title & more\nLead text, loose\nPara one, with link text here.\nPara two, <etc>. Next\nx, y\nz"


def test_page():
    assert X.extract(PAGE) == TEXT
    assert X.extract(None) == X.extract("") == ""
    assert X.extract("plain &eacute; text") == "plain é text"
    assert X.extract("<p>a<p>b<b>c</p>d") == "a\nbc\nd"
    assert X.extract("<article><p>never closed, though long <i>and") == "never closed, though long and"
    X.extract("<" * 3000 + "<p " * 1000 + "'\"" * 500)


def test_host_agrees(spark):
    """A short page whose own best container is a list follows the path of its host."""
    body = lambda text, side: f"<body><div class='main-col'><p>{text}</p></div><div class='links'><ul>{side}</ul></div></body>"
    long = "many words, said slowly, over and over, " * 9
    rows = [(i, f"http://h.example/{i}", body(f"page {i} {long}", "<li>a</li>")) for i in range(6)]
    rows += [(6, "http://h.example/6", body("a short main text, in place", "".join(f"<li>item {k}, with, commas</li>" for k in range(3)))), (7, None, None), (8, None, ""), (8, None, ""), (None, "http://o.example", body(long, ""))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id AS text", "url AS host", "1 AS path")
    found = {(r["page_id"], r["url"]): r["text"] for r in X.extract_pages(pages).collect()}
    assert found[6, "http://h.example/6"] == "a short main text, in place" and found[7, None] == found[8, None] == ""
    assert X.extract(rows[6][2]) != "a short main text, in place" and found[None, "http://o.example"] == long.strip()
    assert X.extract_pages(pages).count() == len(rows) and X.extract_pages(pages.limit(0)).count() == 0


LONG = "Plain prose goes on here, sentence after sentence, as it does in any article that is worth reading. " * 4


def test_without_article_element():
    """Containers by classes alone: wrappers, prose under a doubted word, captions, and what is beside."""
    page = f"""<body><div class="layout with-sidebar comment-theme content"><div class="post-12 entry"><h2>Head</h2><p>{LONG}</p>
    <figure><img src=x><figcaption>A caption, kept</figcaption></figure><div class="related-work search"><p>{LONG}</p></div>
    <div class="related"><a href=1>One more</a></div><div class=share-bar><a href=2>Share</a></div><p>{LONG}</p></div>
    <div class="sidebar"><p>{LONG}</p></div><div class="cookie-notice"><p>{LONG[:250]}</p></div>
    <section id="comments"><article class="comment"><p>{LONG}</p></article></section></div></body>"""
    one = LONG.strip()
    assert X.extract(page) == "\n".join(["Head", one, "A caption, kept", one, one])


def test_class_names_are_all_read():
    a, b = (X.parse(f"<div class='{c}'><p>x</p></div>")[0][1].path for c in ("aa bb cc dd1 ee", "aa bb cc ff ee"))
    assert a != b and a == X.parse("<div class='ee dd22 cc bb aa'>")[0][1].path


def test_every_container_votes():
    page = "<body>" + "".join(f"<div class=c{'abcdefg'[k]}><p>{LONG}</p></div>" for k in range(7)) + "</body>"
    assert len(X.votes(page)) >= 7


def test_host_path_and_a_page_apart():
    """A page of another layout keeps its article beside a box at its host's path."""
    path = next(e.path for e in X.parse(f"<body><div class=content><p>{LONG}</p></div></body>")[0] if e.tag == "div")
    page = f"<body><div class=longread><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class=content><p>{LONG[:350]}</p></div></body>"
    assert X.extract(page, path) == "\n".join([LONG.strip()] * 3)
    page = f"<body><div class=talk><p>{LONG}</p></div><div class=content><p>{LONG[:390]}</p></div></body>"
    assert X.extract(page, path) == LONG[:390].strip()


def test_broken_quotes():
    for quote in "\"'":
        text = X.extract(f"<div class={quote}a b><p>First words here.</p><p id=x>More words.</p></div>")
        assert text == "First words here.\nMore words."
    assert X.extract("<p>a <a href='x>link</a> b, and more of it</p>") == "a link b, and more of it"


def test_deep_and_long_pages():
    """Time and memory by the length of a page, however deep its elements and wrong its tags."""
    pages = [
        "<div class=a>" * 100_000 + "<p>" + LONG,
        "<x-y>" * 20_000 + "</z>" * 20_000 + "<li>" * 20_000 + LONG,
        "<li><div>" + "<x-y>" * 20_000 + "<li></li>" * 20_000 + LONG,
        "<article>" * 15_000 + LONG + "</article>" * 15_000,
        "<p>" + LONG * 3_000,
        "<a href='" * 10_000 + "<p>" + LONG,
    ]
    for page in pages:
        tracemalloc.start()
        began = time.time()
        X.votes(page)
        assert LONG[:20] in X.extract(page) or "href" in page[:10]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.time() - began < 60 and peak < 200e6
