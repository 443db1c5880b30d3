"""Main text of web pages by tree scoring.

A page's tags become a tree, whose root is a container too. Blocks of text give points for their length and commas to
their containers, fewer the farther up, and containers lose points in proportion to the text that stands in links. The
best container is kept: with its article and sibling articles where it is in one, else with all that stands beside it
and its ancestors but blocks that are mostly links. Menus, adverts, forms and the like are left out by tag and role, and
by class name only together with where they stand, how much of their text is links, and what they hold of the points.

Reading is linear in a page's length: a tag that never ends and a quote that never closes are looked for once, and an
end tag asks counters of what is open.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strata.llm.common import bounded_batches

# fixed values: tag names by what they mean here
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = set("script style noscript template svg math canvas head nav aside footer button select option input textarea iframe object embed audio video dialog menu title noframes noembed".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table caption tbody td tfoot th thead tr ul".split())
HOLDERS = set("#root article main section div body td blockquote center html form fieldset details".split())
HEAD_ONLY = set("base link meta script style template title noscript".split())
LISTS = set("ul ol dl menu".split())
ITEMS = set("li dt dd".split())
SCOPES = set("table td th caption button object template svg".split())
BAD_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# fixed values: words of class names and ids that say what a block is, that say it only with other signs, and that say nothing
BAD_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsors sponsored promo promos promotion comment comments commentlist disqus respond reply replies sidebar sidebars "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager "
    "menu menus nav navbar navigation masthead topbar footer header".split()
)
DOUBTFUL_NAMES = set("related recommended recommendations widget widgets share sharing social skip legal copyright rail toolbar banner banners foot".split())
PLAIN_NAMES = set("box block wrap wrapper container list section area bar item items top bottom left right inner outer unit slot panel group row col column site global primary secondary main page post article entry content body text module holder links link top1 form tree thread policy warning".split())
ARTICLE_NAMES = set("article post entry page content section".split())
COMMENT_NAMES = set("comment comments commentlist disqus respond reply replies".split())

START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|(!\[CDATA\[)|[!?/])")
STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s/>\"'=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
COMMAS = re.compile("[,،、，]")
CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}

#: Points of a block: one, one a comma, one a hundred characters up to LONGEST. From LINKS of its text in links a block beside the best container is a menu, from DOUBTFUL a block of a doubtful name isn't text.
LONGEST, LINKS, DOUBTFUL = 3, 0.5, 0.3
#: A form, or a block that its name leaves out, stays where it holds so much of a page's points: it is the page.
WHOLE_PAGE = 0.9


class _Node:
    __slots__ = ("bad", "children", "held", "holder", "inline", "inside", "linked", "linked_own", "length", "commas", "out", "own", "parent", "tag")

    def __init__(self, tag: str, parent: _Node | None, out: bool = False, bad: str = ""):
        self.tag, self.parent, self.out, self.bad, self.children = tag, parent, out, bad, []
        self.inline: dict[str, int] | None = None


def _token(token: str) -> str:
    """What one class or id says: 'bad', 'comment', 'doubtful' or nothing. All its words must be known, one telling."""
    found = {x.lower() for x in NAME.findall(token)}
    if not found or not found & (BAD_NAMES | DOUBTFUL_NAMES) or not found <= BAD_NAMES | DOUBTFUL_NAMES | PLAIN_NAMES | {x for x in found if x.isdigit()}:
        return ""
    if found & COMMENT_NAMES:
        return "comment"
    telling = found & BAD_NAMES
    if telling == {"header"} and found & ARTICLE_NAMES:
        return ""  # the head of an article holds its title
    return "bad" if telling else "doubtful"


def _attributes(text: str) -> tuple[bool, str]:
    """Whether role or hidden says that this isn't text of the article, and what class and id say."""
    out, says = False, ""
    for m in ATTRIBUTE.finditer(text):
        key = m[1].lower()
        if key not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        value = m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for token in value.split():
                says = max(says, _token(token), key=("", "doubtful", "bad", "comment").index)
        elif key == "role":
            out |= value.strip().lower() in BAD_ROLES
        else:
            out |= key == "hidden" or value.strip().lower() == "true"
    return out, says


class _Builder:
    """The open elements: counts of them by scope, so that no end tag searches the stack."""

    def __init__(self) -> None:
        self.root = self.at = _Node("#root", None)
        self.root.inline = {}
        self.blocks: list[_Node] = [self.root]
        self.scopes: list[dict[str, int]] = [{}]
        self.items = [0]
        self.tables: list[dict[str, int]] = [{}]

    def text(self, text: str) -> None:
        if self.scopes[-1].get("head") and not text.isspace():
            self.until("head")
        self.at.children.append(text)

    def pop(self) -> str:
        node = self.at
        tag = node.tag
        self.at = node.parent
        if node.inline is None:
            self.blocks[-1].inline[tag] -= 1
        else:
            self.blocks.pop()
            if tag in LISTS or tag in SCOPES:
                self.items.pop()
            if tag == "table":
                self.tables.pop()
            if tag in SCOPES:
                self.scopes.pop()
            if tag in ITEMS:
                self.items[-1] -= 1
            part = _part(tag)
            if part:
                self.tables[-1][part] -= 1
            self.scopes[-1][tag] -= 1
        return tag

    def until(self, *tags: str) -> None:
        while self.pop() not in tags:
            pass

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.scopes[0].get(tag):
            return
        top = self.scopes[-1]
        if top.get("head") and tag not in HEAD_ONLY:
            self.until("head")
        block = tag in BLOCKS or tag in SCOPES
        if block and top.get("p"):
            self.until("p")
        if tag in ITEMS and self.items[-1]:
            self.until(*ITEMS)
        part = _part(tag)
        if part:
            for closes in {"cell": ("cell",), "row": ("row", "cell"), "part": ("part", "row", "cell")}[part]:
                if self.tables[-1].get(closes):
                    self.until(*[t for t, p in PARTS.items() if p == closes])
        out, says = _attributes(attributes) if attributes else (False, "")
        node = _Node(tag, self.at, out, says)
        self.at.children.append(node)
        if tag in VOID:
            return
        self.at = node
        if not block:
            own = self.blocks[-1].inline
            own[tag] = own.get(tag, 0) + 1
            return
        node.inline = {}
        self.blocks.append(node)
        top = self.scopes[-1]
        top[tag] = top.get(tag, 0) + 1
        if part:
            self.tables[-1][part] = self.tables[-1].get(part, 0) + 1
        if tag in ITEMS:
            self.items[-1] += 1
        if tag in SCOPES:
            self.scopes.append({})
        if tag == "table":
            self.tables.append({})
        if tag in LISTS or tag in SCOPES:
            self.items.append(0)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):  # text after these still belongs to the body
            return
        if tag not in BLOCKS and tag not in SCOPES:
            if self.blocks[-1].inline.get(tag):  # one that a block was opened in stays open with it
                self.until(tag)
        elif self.scopes[-1].get(tag):
            self.until(tag)
        elif tag in SCOPES and len(self.scopes) > 1 and self._scope_open(tag):
            self.until(tag)

    def _scope_open(self, tag: str) -> bool:
        """Whether the end of a scope closes one that is open: the innermost, or a table around open cells."""
        if tag == "table":
            return len(self.tables) > 1
        return bool(self.scopes[-2].get(tag)) if tag not in ("td", "th") else bool(self.tables[-1].get("cell") and self.scopes[-2].get(tag))


PARTS = {"td": "cell", "th": "cell", "tr": "row", "tbody": "part", "thead": "part", "tfoot": "part", "caption": "cell"}


def _part(tag: str) -> str | None:
    return PARTS.get(tag)


def _tree(page: str) -> _Node:
    build = _Builder()
    end, n = 0, len(page)
    no_more = {'"': n + 1, "'": n + 1}  # from where on a quote isn't found
    while end < n:
        m = START.search(page, end)
        if m is None:
            build.text(page[end:])
            break
        if m.start() > end:
            build.text(page[end : m.start()])
        if m[3] or m[4]:
            close = "-->" if m[3] else "]]>"
            stop = page.find(close, m.end())
            if m[4]:
                build.text(page[m.end() : stop if stop >= 0 else n])
            elif page.startswith((">", "->"), m.end()):  # <!--> and <!---> are whole comments
                stop, close = page.find(">", m.end()), ">"
            end = stop + len(close) if stop >= 0 else n
            continue
        if m[2] is None:
            end = page.find(">", m.end()) + 1 or n
            continue
        at, stop = m.end(), -1
        while True:
            s = STOP.search(page, at)
            if s is None:
                break
            if s[1] is None:
                stop = s.start()
                break
            at = s.end()
            close = page.find(s[1], at) if at < no_more[s[1]] else -1
            if close >= 0:
                at = close + 1
            else:
                no_more[s[1]] = min(no_more[s[1]], at)
        if stop < 0:
            break  # a tag that never ends is no text
        tag, end = m[2].lower(), stop + 1
        if m[1]:
            build.end(tag)
            continue
        build.start(tag, page[m.end() : stop])
        if tag in RAW:
            close = CLOSE[tag].search(page, end)
            if close is None:
                break
            end = page.find(">", close.end()) + 1 or n
            build.end(tag)
    return build.root


def _in_order(root: _Node) -> list[_Node]:
    """All nodes, each before its children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.children if not isinstance(x, str))
    return order


def _measure(order: list[_Node]) -> None:
    """Text, linked text and points of all nodes that aren't left out, from the leaves up."""
    for node in reversed(order):
        node.length = node.linked = node.own = node.linked_own = node.commas = 0
        node.held = 0.0
        if node.out:
            continue
        for x in node.children:
            if isinstance(x, str):
                k = len(x.strip())
                if k:
                    node.length += k
                    node.own += k
                    node.commas += len(COMMAS.findall(x))
            elif not x.out:
                node.length += x.length
                node.linked += x.linked
                node.held += x.held
                if x.inline is None:
                    node.own += x.own
                    node.linked_own += x.linked_own
                    node.commas += x.commas
        if node.tag == "a":
            node.linked, node.linked_own = node.length, node.own
        if node.inline is not None and node.own:
            node.held += _points(node)


def _points(node: _Node) -> float:
    return (1 + node.commas + min(node.own / 100, LONGEST)) * (1 - node.linked_own / node.own)


def _leave_out(order: list[_Node]) -> None:
    """Marks what isn't text of the article, and all below it."""
    for node in order:
        up = node.parent
        node.inside = up is not None and (up.inside or up.tag in ("article", "main"))
        node.holder = None if up is None else up if up.tag in HOLDERS else up.holder
        node.out = (up is not None and up.out) or (node.out and node.tag not in ("html", "body")) or node.tag in LEFT_OUT or (node.tag == "header" and not node.inside)
    _measure(order)
    holding: set[_Node] = set()  # what holds an article isn't left out by its name
    for node in reversed(order):
        if not node.out and (node in holding or (node.tag in ("article", "main") and not node.bad)) and node.parent is not None:
            holding.add(node.parent)
    total = order[0].held
    changed = False
    for node in order:
        if node.out:
            continue
        if node.parent is not None and node.parent.out:
            node.out = True
            continue
        if not node.bad and node.tag != "form":
            continue
        if node in holding or node.tag in ("html", "body", "main", "h1"):
            continue
        if node.bad == "comment":
            node.out = True
        elif node.bad == "doubtful" and node.tag != "form":
            node.out = node.linked >= DOUBTFUL * max(1, node.length) or (not node.inside and not any(not isinstance(x, str) and x.inline is not None for x in node.children))
        else:
            node.out = not total or node.held < WHOLE_PAGE * total
        changed |= node.out
    if changed:
        _measure(order)


def extract_text(page: str | None) -> str:
    """The main text of one page, blocks joined by a line end; empty for no page or no text."""
    if not page:
        return ""
    root = _tree(page)
    order = _in_order(root)
    _leave_out(order)
    score: dict[_Node, float] = {}
    for node in order:
        if node.out or node.inline is None or not node.own:
            continue
        points, share = _points(node), 1.0
        up = node if node.tag in HOLDERS else node.holder
        for far in range(1, 5):
            if up is None:
                break
            score[up] = score.get(up, 0.0) + points * share
            up, share = up.holder, 1 / (2 * far)
    if not score:
        return ""
    depth_first = {node: i for i, node in enumerate(order)}
    fair = {x: s * (1 - x.linked / max(1, x.length)) * (1.5 if x.tag in ("article", "main") else 1.0) for x, s in score.items()}
    best = max(fair, key=lambda x: (fair[x], depth_first[x]))  # of equals the later one in page order that is inmost
    at = best
    while at is not None and at.tag not in ("article", "main"):
        at = at.parent
    if at is None:
        return "\n".join(_blocks(_beside(best)))
    kept: list[_Node | str] = [at]
    if at.tag == "article" and at.parent is not None:  # its sibling articles, and the title that stands before them
        kept = [x for x in at.parent.children if x is at or (not isinstance(x, str) and not x.out and (x.tag in ("h1", "hgroup") or (x.tag == "article" and x.linked < LINKS * max(1, x.length))))]
    return "\n".join(b for x in kept for b in _blocks(x))


def _beside(best: _Node) -> _Node:
    """The root, rid of what stands beside the best container and its ancestors and is mostly links."""
    at = best
    while at.parent is not None:
        runs = _runs(at.parent, at)
        for run in runs:
            if at in run:
                continue
            text = sum(len(x.strip()) if isinstance(x, str) else x.length for x in run)
            if text and sum(x.linked for x in run if not isinstance(x, str)) >= LINKS * text:
                run.clear()
        at.parent.children = [x for run in runs for x in run]
        at = at.parent
    return at


def _runs(node: _Node, inside: _Node) -> list[list[_Node | str]]:
    """The children of a node as they are set: `inside` and each block alone, text and inline tags between them together."""
    runs: list[list[_Node | str]] = [[]]
    for x in node.children:
        if isinstance(x, str) or (x is not inside and x.inline is None):
            if isinstance(x, str) or not x.out:
                runs[-1].append(x)
        elif not x.out:
            runs += [[x], []]
    return runs


def _blocks(top: _Node) -> list[str]:
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    stack: list[_Node | str | None] = [top]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(references.unescape(x) if "&" in x else x)
        elif not x.out:
            if x.tag == "br":
                run.append("\n")
            if x.inline is not None or x.tag == "hr":
                close()
                stack.append(None)
            stack.extend(reversed(x.children))
    close()
    return blocks


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep: dict[str, Column] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text and its length in code points; then the columns in `keep`.

    Null and empty html, and pages without text, give an empty text; a page without containers or paragraphs gives what
    text it has; rows that repeat an id stay apart; other columns aren't read. White space is what `str.split` takes for
    it, decoded no-break spaces included. Of containers of equal score the inmost, then the last, is best. An empty
    table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), *[c.alias(n) for n, c in (keep or {}).items()])
    kept = [f for f in rows.schema.fields if f.name not in ("page_id", "url", "html")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(x) for x in batch.column("html").to_pylist()]
            made = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*made, *(batch.column(f.name) for f in kept)], ["page_id", "url", "text", "n_chars", *(f.name for f in kept)])

    base = [StructField("page_id", LongType()), StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType())]
    return rows.mapInArrow(run, StructType([*base, *kept]))
