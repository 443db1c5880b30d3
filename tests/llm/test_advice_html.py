"""Pages of split sections without <article> lose nothing but menus and adverts."""

from strata.llm import html_extract

LONG = "A long paragraph, with commas, and with enough words in it to make its container the best one of the page by far, as it should be."


def page(beside: str) -> str:
    return f'<body><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul><div id="page"><h1>Title</h1><p>Short lead.</p><div class="text"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>{beside}</div><div class="footer">foot</div></body>'


def test_a_heading_and_a_short_paragraph_beside_the_best_container_stay():
    assert html_extract.extract_text(page("")).split("\n") == ["Title", "Short lead.", LONG, LONG, LONG]


def test_short_sections_lists_and_bare_text_stay_but_links_do_not():
    beside = '<div><p>Two.</p><p>Three.</p></div><section>Four.</section><ul><li>Five</li></ul><div><a href="y">Next page</a> <a href="z">Last page</a></div><div class="sidebar"><p>Buy this.</p></div><pre>x = 1</pre>'
    assert html_extract.extract_text(page(beside)).split("\n") == ["Title", "Short lead.", LONG, LONG, LONG, "Two.", "Three.", "Four.", "Five", "x = 1"]
    assert html_extract.extract_text(page('<p>Six.</p>seven <b>bold</b> <a href="x">link</a> more')).split("\n")[-2:] == ["Six.", "seven bold link more"]


def test_what_stands_higher_up_stays():
    assert html_extract.extract_text(f"<body><h1>Top</h1><div><div><p>{LONG}</p></div><p>Near.</p></div><p>End.</p></body>").split("\n") == ["Top", LONG, "Near.", "End."]


def test_short_second_article_and_page_without_body_stay():
    assert html_extract.extract_text(f"<body><article><p>{LONG}</p></article><article><p>Short.</p></article></body>").split("\n") == [LONG, "Short."]
    assert html_extract.extract_text("<h1>Title</h1><p>Text.</p>") == "Title\nText."
