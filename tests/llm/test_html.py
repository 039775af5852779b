import re
from html import unescape

from punctual.llm import html, queries
from llm.data import SF

PAGE = """<!doctype html><html><head><title>T</title><style>.a{}</style></head><body>
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href="/a">Menu one</a><li><a href='/b'>Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies and more cookies on this site of ours.</div>
<main><h1>Real &amp; title</h1><p>First   paragraph with
 several <b>words</b> in it, and <a href="x>y">a link</a>.<script>if (a<b) alert("</p>")</script>
<div class=ad>Buy now buy now</div><p>Second&nbsp;one &lt;here&gt; 3 < 4.<table><tr><td>a cell with a few words</td></tr></table>
<form><input>Search<button>Go</button></form><aside>Related things to read</aside></main>
<section id="comments"><p>Reader says a lot of words here that nobody wants to have in it.</p></section>
<footer>Imprint words words words</footer></body></html>"""


def test_page_by_hand():
    text = html.extract(PAGE, html.DEFAULT)
    assert text == "Real & title\nFirst paragraph with several words in it, and a link.\nSecond one <here> 3 < 4.\na cell with a few words"


BOX = "<aside><p>" + "buy this now " * 40 + "</p><form>subscribe</form></aside>"
MENU = "<nav>" + "<a href=/>menu</a> " * 30 + "</nav>"


def test_boxes_near_the_ends_of_an_article():
    """The shorter side of a long box stays, in marked articles and in plain containers."""
    body = "<p>" + "body words " * 30 + "</p>"
    for weights in (html.DEFAULT, {"word": 1.0, **html.LOWEST}):
        for tag in ("article", "div"):
            for inner in (f"<h1>Short head</h1><p>The lead.</p>{BOX}{body}", f"{body}{BOX}<p>Short tail here.</p>", f"<h1>Short head</h1>{BOX}{body}{BOX}<p>Short tail of it.</p>"):
                want = " ".join(re.sub("<[^>]*>", " ", inner.replace(BOX, "")).split())
                page = f"<body>{MENU}<{tag}>{inner}</{tag}><footer>Imprint words</footer></body>"
                if tag == "article" or weights is html.DEFAULT:
                    assert " ".join(html.extract(page, weights).split()) == want


def test_articles_nested_in_main_and_short_last_paragraphs():
    lowest = {"word": 1.0, **html.LOWEST}
    one, two = "<p>" + "first words " * 9 + "</p>", "<p>" + "second words " * 5 + "</p><p>End.</p>"
    for weights in (html.DEFAULT, lowest):
        got = html.extract(f"<body>{MENU}<main><h1>Title</h1><article>{one}</article>{BOX}<article>{two}</article></main><footer>x</footer></body>", weights)
        assert got == "\n".join(["Title", ("first words " * 9).strip(), ("second words " * 5).strip(), "End."])


def test_furniture_between_containers_still_ends_the_region():
    page = f"<body><div><p>Some site slogan</p></div>{MENU}{BOX}<div><p>" + "text words " * 20 + "</p></div></body>"
    assert html.extract(page, html.DEFAULT) == ("text words " * 20).strip()


def test_query_equals_the_marked_article(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op3_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_without_article_marks(spark):
    """Weights learned from marked pages find the same text when the marks are taken away."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html.learn_weights(pages)
    assert weights["word"] > 0 > max(weights["link"], weights["furniture"], weights["block"], weights["inline"], weights["edge"])
    for r in pages.collect():
        plain = re.sub(r"</?article>", lambda m: m[0].replace("article", "div"), r["html"])
        got, want = set(html.extract(plain, weights).split()), set(html.extract(r["html"], weights).split())
        assert len(got & want) >= 0.9 * len(got | want)


ODD = [
    None, "", "plain words only", "<p>unclosed <b>bold <i>italic", "<p>cut off <a hre", "<nav>menu <p>text</p>", "<div class='x", "&am &#65; &#x42; &copy",
    "<p>" + "word " * 50000 + "</p>", "<!-- never closed <p>a</p>", "<script>never closed", "<<<>>> a < b", "</p></div></nav>stray", "<p>same</p><p>same</p>",
    "<" * 3000, "<a " * 2000, "<p title='" + "x" * 20000,
]


def test_odd_and_empty(spark):
    pages = spark.createDataFrame([(k, f"u{k}", h, "t", "n") for k, h in enumerate(ODD)], "page_id long, url string, html string, text string, kind string")
    rows = {r["page_id"]: r for r in html.extract_pages(pages, weights=html.DEFAULT).collect()}
    assert rows[0]["text"] == rows[1]["text"] == "" and rows[0]["n_chars"] == 0 and rows[0]["kind"] == "n"
    assert rows[2]["text"] == "plain words only" and rows[3]["text"] == "unclosed bold italic" and rows[4]["text"] == "cut off"
    assert rows[7]["text"] == "&am A B ©" and rows[8]["n_chars"] == 249999 and rows[13]["text"] == "same\nsame"
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_names_that_are_about_furniture():
    body = "<p>" + "some words of the text " * 20 + "</p>"
    text = ("some words of the text " * 20).strip()
    for name in ("content with-sidebar", "no-sidebar", "has_sidebar page", "without-comments"):
        assert html.extract(f"<html><body><div class='{name}'>{body}</div></body></html>", html.DEFAULT) == text
    assert html.extract(f"<html><body><div class='main'>{body}</div><div class='left sidebar'>{body}</div></body></html>", html.DEFAULT) == text
    headed = f"<article><h2 id='search-methods'>Search methods</h2>{body}<p id=related>Last words</p></article>"
    assert html.extract(headed, html.DEFAULT) == f"Search methods\n{text}\nLast words"
    hidden = f"<article>{body}<div data-id='comments'><p>More words</p></div><div id='comments'><p>Not these</p></div></article>"
    assert html.extract(hidden, html.DEFAULT) == f"{text}\nMore words"


def test_options_without_end_tags():
    body = "<p>" + "some words of the text " * 20 + "</p>"
    text = ("some words of the text " * 20).strip()
    for options in ("<option>one<option>two", "<option>one</option><option>two", "<option value=1>"):
        page = f"<article>{body}<datalist>{options}</datalist><p>after it</p></article>"
        assert html.extract(page, html.DEFAULT) == f"{text}\nafter it"
