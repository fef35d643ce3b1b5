import pytest

from vitrine.llm import htmltext

BODY = "The river rose by two metres during the night, and the ferry stopped. " * 3


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>Site - story</title><style>p {{color: red}}</style><script>var a = '<p>no</p>';</script></head><body>{before}{article}{after}</body></html>"


def squeezed(text):
    return " ".join(text.split())


@pytest.mark.parametrize("frame", [
    ("<nav><ul><li><a href='/'>Home</a></li><li>News</li></ul></nav>", "<footer>Copyright</footer>"),
    ("<header><h1>The Daily Site</h1></header><div class='menu'>A | B | C</div>", "<aside>Related things you may like</aside>"),
    ("<div id=\"cookie-notice\">We use cookies to make this page better for you and all of our partners in advertising.</div>", "<div class='ad-banner'>Buy now</div>"),
    ("<form action=/s><input name=q><button>Go</button></form>", "<section class='comments'><h2>Comments</h2><p>First! I think that this article is far too long to read in one sitting.</p></section>"),
    ("<!-- nothing --> ", "<div class=sidebar><p>" + "Other stories of the day that are long enough. " * 4 + "</p></div>"),
])
def test_article_without_what_surrounds_it(frame):
    for article in (f"<article><h1>River rises</h1><p>{BODY}</p><p>Short end.</p></article>", f"<div class='content'><h1>River rises</h1><p>{BODY}</p><p>Short end.</p></div>", f"<main><h1>River rises</h1><p>{BODY}</p><p>Short end.</p></main>"):
        assert htmltext.main_text(page(article, *frame)) == f"River rises {squeezed(BODY)} Short end."


def test_references_white_space_and_inline_markup():
    html = page(f"<article><p>Caf&eacute; &amp; bar&nbsp;&#8212; <b>bo</b>ld\n\n  <a href='x'>link</a>&#x21;</p><ul><li>one</li><li>two</li></ul><p>{BODY}</p></article>")
    assert htmltext.main_text(html) == f"Café & bar — bold link! one two {squeezed(BODY)}"


def test_broken_markup_doesnt_lose_the_article():
    html = f"<body><div class=nav><ul><li>Home<li>News</div><article><p>{BODY}<p>Unclosed <b>bold<p>end</article><footer>f"
    assert htmltext.main_text(html) == f"{squeezed(BODY)} Unclosed bold end"


@pytest.mark.parametrize("html", [None, "", " ", "<", "<<<>>>", "<!--", "<script>", "<p", "<a href='" + "x" * 100_000, "<div>" * 20_000, "&" * 5000, "\x00<p>\x00</p>"])
def test_odd_pages(html):
    assert htmltext.main_text(html) == "" or "<div" not in htmltext.main_text(html)


def test_a_long_article_is_kept_whole():
    paragraphs = [f"Paragraph number {i} of a long article with enough words in it to count." for i in range(20_000)]
    assert htmltext.main_text(page("<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>")) == " ".join(paragraphs)


ARTICLE = f"<h1>River rises</h1><p>{BODY}</p><p>Short end.</p>"


@pytest.mark.parametrize("html", [
    f"<article>{ARTICLE}</article><section class='comments'><article><p>{BODY} First!</p></article><article>Second, and longer.</article></section>",
    f"<div class='content'>{ARTICLE}</div><section class='comments'><article><p>{BODY} First!</p></article></section>",
    f"<article>{ARTICLE}</article><aside><article><h2>Teaser</h2><p>Read this instead.</p></article></aside>",
    f"<div class='layout with-sidebar'><div class=col>{ARTICLE}</div></div>",
    f"<div class='page widget'><nav>Home</nav><div>{ARTICLE}</div></div>",
    f"<form action=/x><div>{ARTICLE}</div></form>",
    f"<nav><ul><li>Home<li>News<article>{ARTICLE}</article>",
    f"<div id=main-nav><a href=/>Home</a></div>{ARTICLE}<div class='post-comments-2'>No!</div><div class=leftSidebar>Other</div>",
    f"<div data-x='{'y' * 9000}' class=t>{ARTICLE}</div>",
    f"<article>{ARTICLE}</article><article class=comment><p>{BODY}</p></article>",
    f"<p hidden>secret</p><article>{ARTICLE}<div style='display:none'>x</div><p class=ad>Buy</p></article>",
])
def test_marks_are_evidence_and_not_verdicts(html):
    assert htmltext.main_text(page(html)) == f"River rises {squeezed(BODY)} Short end."


def test_words_of_classes_inside_an_article():
    assert htmltext.main_text(page("<article><p id=share-price>Shares rose.</p><p class=searching>They looked.</p><div id=share>Tweet</div></article>")) == "Shares rose. They looked."


def test_a_short_article_without_a_mark():
    assert htmltext.main_text(page("<div><h1>Rain</h1><p>It rained.</p></div>", "<nav>Home</nav>", "<footer>All rights reserved, and more of it</footer>")) == "Rain It rained."


def test_a_long_attribute_is_no_text():
    value = "a > b " * 3000
    assert htmltext.main_text(page(f"<article><p title=\"{value}\" class='t'>{BODY}</p></article>")) == squeezed(BODY)


def brute(html):
    """Pages of the tables: what stands between the article's tags, by regular expressions only."""
    import html as h
    import re

    inner = re.search(r"<article>(.*)</article>", html or "", re.S)
    inner = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", inner[1] if inner else "", flags=re.S)
    inner = re.sub(r"</?(b|a|i|em|span)\b[^>]*>", "", inner)
    return " ".join(h.unescape(re.sub(r"<[^>]+>", " ", inner)).split())


def test_against_the_marked_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        assert found[r["page_id"]] == brute(r["html"])


def test_every_row_comes_back(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = htmltext.extract(pages)
    assert found.count() == pages.count()
    assert found.where("n_chars <> char_length(text) or text is null").count() == 0
    assert found.where("text rlike '</?(p|div|a|span|script|li)[ >]'").count() == 0


def test_odd_rows_and_empty_table(spark):
    from pyspark.sql import functions as F

    rows = [(None, "u", page(f"<p>{BODY}</p>")), (1, None, None), (2, "u", ""), (3, "u", "<p>x"), (3, "u", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("t"), "n_chars": F.lit("n")})
    found = htmltext.extract(pages).collect()
    assert len(found) == 5 and {(r["page_id"], r["n_chars"]) for r in found if r["page_id"] in (1, 2)} == {(1, 0), (2, 0)}
    assert next(r["text"] for r in found if r["page_id"] is None) == squeezed(BODY)
    assert htmltext.extract(pages.limit(0)).count() == 0
