"""Pages without article or containers, hostile pages, class names, and the given pages against a plain version."""

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from strata.llm import html_extract
from strata.llm.html_extract import extract_text
from tests.conftest import DATA

LONG = "A long paragraph, with commas, and with enough words in it to make its container the best one of the page by far, as it should be."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("Hello world, plain text.", "Hello world, plain text."),
        ("<p>Hello, this is a paragraph.</p>", "Hello, this is a paragraph."),
        ("<html><body><div><span>Some long text</span></div></body></html>", "Some long text"),
        (f"<body><h1>Title</h1><div><p>{LONG}</p></div></body>", f"Title\n{LONG}"),
        (f"<main><h1>Title</h1><article><p>{LONG}</p></article></main>", f"Title\n{LONG}"),
        (f"<div><p>{LONG}</p></div><div><p>Bye.</p></div>", f"{LONG}\nBye."),
        (f'<article><h1>T</h1><p>{LONG}</p><div class="related-work"><p>Related.</p></div><div class="row legal"><p>Legal.</p></div></article>', f"T\n{LONG}\nRelated.\nLegal."),
        (f'<article><p>{LONG}</p><div class="related"><a href="/x">More, of, this</a></div><div id="comment-list"><p>First!</p></div></article>', LONG),
        (f'<div class="ad">Buy.</div><div class="siteNav">x</div><div class="content"><p>{LONG}</p></div><div class="cookie-notice">Cookies.</div>', LONG),
        ("<form><div><p>A whole page, in a form.</p></div><input></form>", "A whole page, in a form."),
        ("<div><ul><li>one</div><div>two</div>", "one\ntwo"),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "a\nb\nc\nd"),
        ("<b><p>x</b>y</p>z", "xy\nz"),
        ("a &lt; b &#233; &amp;amp; x &unknown; y", "a < b é &amp; x &unknown; y"),
        ("x < y, 1<2 <p title='a>b'>t", "x < y, 1<2\nt"),
        ("one<!-- a --><!--> two <![CDATA[three]]><script>no</script>", "one two three"),
        ("cut off <a href='x", "cut off"),
        ("<nav>menu</nav>", ""),
    ],
)
def test_pages(page, text):
    assert extract_text(page) == text


@pytest.mark.parametrize("piece", ["<a ", "<a>", "</p>", "<div>", '<a href="', "<ul><li>", "<table><tr><td>", "</b><i>", "<b><div>", "<!--", "<p>x", "<![CDATA[", "<a b='", "<td>", "</td>", "<table></td>", "=\" "])
def test_time_grows_with_the_page(piece):
    def took(n):
        at = time.process_time()
        extract_text("<div><p>a" + piece * n)
        return time.process_time() - at

    took(1000)
    assert took(40_000) < 12 * took(10_000) + 0.2  # 4 times the page; the square would be 16 times


def test_ties_go_to_the_inmost_container():
    assert extract_text("<div><div><p>One, two.</p></div></div><div><a href='x'>menu</a></div>") == "One, two."


def plain_article(page):
    """The text of the article element by plain replacement of tags."""
    text = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    text = re.sub(rf"</?(?:{'|'.join(sorted(html_extract.BLOCKS, key=len, reverse=True))})\b[^>]*>", "\0", text)
    text = re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", text))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in text.split("\0")) if x)


def test_given_pages():
    rows = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    assert rows and all(extract_text(r["html"]) == plain_article(r["html"]) for r in rows)
