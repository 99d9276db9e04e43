"""Template blocks that no mark names, found by the votes of a host's pages."""

from tracemill.llm import html_extract


def _texts(spark, htmls, host="h.example"):
    pages = [(i, f"http://{host}/{i}", h) for i, h in enumerate(htmls)]
    return {r["page_id"]: r["text"] for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_two_layouts_and_blocks_that_some_pages_lack(spark):
    one = "<article><h1>T{i}</h1><div class='x'>Read more on our site</div><p>Body {i} of one</p></article>"
    two = "<article><section class='y'><h2>T{i}</h2><div class='z'>Ask our team</div></section><p>Body {i} of two</p></article>"
    out = _texts(spark, [(one if i % 2 else two).format(i=i) for i in range(24)])
    assert out == {i: f"T{i}\nBody {i} of {'one' if i % 2 else 'two'}" for i in range(24)}


def test_constant_paragraph_beside_varying_ones(spark):
    page = "<article><p>Body {i} first</p><p>All rights of this story are ours</p><p>Body {i} second</p></article>"
    assert _texts(spark, [page.format(i=i) for i in range(12)]) == {i: f"Body {i} first\nBody {i} second" for i in range(12)}


def test_small_hosts_and_copies(spark):
    page = "<article><p>Story {i} tells something new</p><div class='x'>Read more</div></article>"
    assert _texts(spark, [page.format(i=i) for i in range(3)]) == {i: f"Story {i} tells something new" for i in range(3)}
    # two near copies: what they share is most of the page and stays; exact copies vote once
    near = "<article><p>A long first paragraph that both copies share</p><p>Second {i}</p></article>"
    assert all("share" in t for t in _texts(spark, [near.format(i=i) for i in range(2)]).values())
    same = [f"<nav>{i}</nav><article><p>Same text</p><p>Again</p></article>" for i in range(9)]
    assert set(_texts(spark, same).values()) == {"Same text\nAgain"}


def test_links_by_markup(spark):
    out = _texts(spark, ["<div><a href='/'>Home</a> | <a href='/b'>News today</a></div><div><p>News today</p><p>Much <a href='/c'>happened</a> here</p></div>"])
    assert out[0] == "News today\nMuch happened here"


def test_deep_pages(spark):
    """Thousands of nested or unclosed blocks, and an article below them."""
    deep = "<p>Menu</p>" + "<div>" * 3000 + "<article><h1>T{i}</h1><p>Body {i}</p></article>" + "</div>" * 3000 + "<p>Imprint</p>"
    unclosed = "<blockquote>" * 5000 + "<p>Last {i}</p>"
    out = _texts(spark, [(deep if i % 2 else unclosed).format(i=i) for i in range(6)])
    assert out == {i: f"T{i}\nBody {i}" if i % 2 else f"Last {i}" for i in range(6)}
