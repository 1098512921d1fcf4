"""Main text of a page by composite text density.

For every node of the page's tree: characters, tags, link characters and link tags of
its subtree give a density of characters a tag, lowered by the share of links.  A node's
density sum adds those of its children; the node with the largest sum is the core of the
page.  The least density on the path from that node up to the body is the page's
threshold: subtrees elsewhere that reach it add their own node of largest sum.  Where
the core lies in an article or main element, that whole element is taken in its place.

Elements that are never content (menus, page headers and footers, sidebars, forms,
scripts, styles) and blocks whose role, or whose class or id, names a menu, reader
comments or consent are left out of the tree before densities are taken.  A class or id
that only may name something else (``hidden``, ``widget``, ``share``, ``notice``, ``ad``,
...) is weighed by density, with the core sought in article and main elements first: around
the core it says nothing, and where blocks so named
hold over half of the core's text, those with a node that reaches the threshold stay.  Elsewhere such
blocks are left out.  Nothing of what remains is dropped or shortened.

Tags are found in time linear in the page, whatever its quotes: where a quoted value is
never closed, the tag ends at the next ``>``.

A block is the text between the borders of block elements; ``br`` is white space.

Defined cases: null or empty html gives an empty text; text without any tag is one
block; unclosed, crossing and unmatched tags are repaired as browsers do, but an element
without content that is never closed ends at once, scripts and styles excepted; a form
around most of the page's text is no form; repeated pages each keep their row; an empty
table gives an empty one; further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from folium.llm.common import let_workers_import

# Element names and the words that name parts of a page that aren't its article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title xmp".split())
#: Of these, elements that hold markup: they may nest, close themselves or stay open.
NESTING = frozenset("noscript template object svg math canvas".split())
LEFT_OUT = frozenset("head nav footer aside form button select dialog menu audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("caption tbody td tfoot th thead tr body html legend".split())
#: An opening tag ends open elements of these names, up to the nearest of its borders.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
P_BORDERS = frozenset("table td th caption button object article section main div body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES_ALWAYS = frozenset("comment comments commentlist disqus respond replies cookie cookies consent gdpr".split())
NAMES_OTHER = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner "
    "sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget "
    "widgets pagination pager paywall teaser hidden".split()
)
#: Before such a word these say what the page around it is like.
STATES = frozenset("no has with without".split())
ROLES_OTHER = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split()
)

#: A tag without angle brackets in its values, which nearly all are.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Tags:
    """Where the tags of a page end.

    What follows a quote outside of values is the same for every tag that comes to it, so
    it is worked out once: all tags together take time linear in the page.
    """

    def __init__(self, html: str):
        self.html = html
        self.known: dict[int, int] = {}
        #: The last search of either kind: from where, and what it found.
        self.special, self.bracket = (0, -1), (0, -1)

    def _special(self, at: int) -> int:
        m = SPECIAL.search(self.html, at)
        return m.start() if m else len(self.html)

    def after_bracket(self, at: int) -> int:
        """The place behind the next ``>``; -1 without one."""
        start, place = self.bracket
        if not start <= at <= place:
            place = self.html.find(">", at)
            place = len(self.html) if place < 0 else place
            self.bracket = at, place
        return place + 1 if place < len(self.html) else -1

    def end(self, at: int) -> int:
        """The place behind the tag whose name ends here; -1 if it doesn't end."""
        html = self.html
        start, place = self.special
        if not start <= at <= place:
            place = self._special(at)
            self.special = at, place
        chain, got = [], -1
        while place < len(html):
            if html[place] == ">":
                got = place + 1
                break
            if place in self.known:
                got = self.known[place]
                break
            chain.append(place)
            close = html.find(html[place], place + 1)
            if close < 0:
                break
            place = self._special(close + 1)
        for quote in chain:
            self.known[quote] = got
        return got if got >= 0 else self.after_bracket(at)

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """The next tag or comment: its place, its end, slash, name, attributes; the page's end without one."""
        html = self.html
        while True:
            lt = html.find("<", at)
            if lt < 0:
                break
            m = PLAIN_TAG.match(html, lt)
            if m:
                return lt, m.end(), m[1], m[2], m[3]
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 4)
                return lt, close + 3 if close >= 0 else len(html), "", "", ""
            if self.after_bracket(lt) < 0:
                # Nothing but an open comment is left to find.
                at = html.find("<!--", lt)
                if at < 0:
                    break
            elif html[lt + 1] in "!?":
                return lt, self.after_bracket(lt), "", "", ""
            else:
                m = TAG_NAME.match(html, lt)
                if m:
                    end = self.end(m.end())
                    return lt, end, m[1], m[2], html[m.end() : end - 1]
                at = lt + 1
        return len(html), len(html), "", "", ""


class Node:
    __slots__ = (
        "tag", "parent", "parts", "other", "named", "raw", "chars", "tags", "link_chars", "link_tags", "density", "total"
    )

    def __init__(self, tag: str, parent: Node | None, other: bool = False, named: bool = False):
        self.tag, self.parent, self.other = tag, parent, other
        #: Whether only a word of its class or id speaks against it.
        self.named = named
        #: Scripts and the like beneath it, which are tags without nodes.
        self.raw = 0
        #: Texts and child nodes in page order.
        self.parts: list[str | Node] = []


def _other(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's own name or attributes say, or may say, that it isn't part of the article."""
    named = False
    if tag in LEFT_OUT:
        return True, named
    if not attributes or tag in ("html", "body", "main", "article"):
        return False, named
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words = [w.lower() for w in WORDS.findall(value)]
            said = {w for before, w in zip(["", *words], words) if before not in STATES}
            if said & NAMES_ALWAYS:
                return True, named
            named = named or bool(said & NAMES_OTHER)
        elif name == "role":
            if value.lower() in ROLES_OTHER:
                return True, named
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, named
        elif name == "hidden" or value.lower() == "true":
            return True, named
    return False, named


def _closes(html: str, tag: str, tags: Tags) -> dict[int, int]:
    """Where each opening tag of a nesting element ends: the end of its own closing tag."""
    found, still, done = {}, [], 0
    for m in re.finditer(rf"<(/?){tag}(?![^\s/>])", html, re.I):
        if m.start() < done:
            continue
        done = tags.end(m.end())
        if done < 0:
            break
        if m[1]:
            if still:
                found[still.pop()] = done
        elif html[done - 2] != "/":
            still.append(done)
    return found


def tree(html: str) -> Node:
    """The page's elements; those that are never content are marked."""
    top = node = Node("html", None)
    tags = Tags(html)
    closes: dict[str, dict[int, int]] = {}
    open_to_end: set[str] = set()
    opened: dict[str, int] = {}
    at, end = 0, len(html)

    def pop(to: Node) -> Node:
        """Closes the open elements up to and with this one."""
        here = node
        while True:
            opened[here.tag] -= 1
            if here is to:
                return here.parent
            here = here.parent

    while at < end:
        start, end_of_tag, slash, tag, attributes = tags.next(at)
        if start > at:
            node.parts.append(html[at:start])
        at = end_of_tag
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if opened.get(tag):
                here = node
                while here.tag != tag:
                    here = here.parent
                node = pop(here)
            continue
        if tag in RAW:
            node.raw += 1
            if tag in NESTING:
                if not attributes.endswith("/"):
                    if tag not in closes:
                        closes[tag] = _closes(html, tag, tags)
                    # One that stays open holds nothing.
                    at = closes[tag].get(at, at)
                continue
            close = -1
            if tag not in open_to_end:
                m = re.compile(rf"</{tag}\b", re.I).search(html, at)
                close = tags.after_bracket(m.end()) if m else -1
            if close >= 0:
                at = close
            elif tag in ("script", "style"):
                at = end
            else:
                open_to_end.add(tag)
            continue
        if tag in ("html", "body"):
            # One node stands for the page's own frame.
            continue
        if tag in CLOSES_P and opened.get("p"):
            here = node
            while here.tag != "p" and here.tag not in P_BORDERS and here.parent is not None:
                here = here.parent
            if here.tag == "p":
                node = pop(here)
        if tag in IMPLIED_END:
            ends, borders = IMPLIED_END[tag]
            if any(opened.get(x) for x in ends):
                here = node
                while here.tag not in ends and here.tag not in borders and here.parent is not None:
                    here = here.parent
                if here.tag in ends:
                    node = pop(here)
        if tag == "body" or (tag not in LEFT_OUT and tag in CLOSES_P and opened.get("head")):
            here = node
            while here.tag != "head":
                here = here.parent
            node = pop(here)
        child = Node(tag, node, *_other(tag, attributes))
        node.parts.append(child)
        if tag not in VOID and not attributes.endswith("/"):
            opened[tag] = opened.get(tag, 0) + 1
            node = child
    return top


def _in_order(top: Node) -> list[Node]:
    """Each node before its children."""
    found, todo = [], [top]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return found


def _unwrap_forms(top: Node, order: list[Node]) -> None:
    """A form that holds most of the page's text is the page's frame, not a form."""
    chars: dict[int, int] = {}
    for node in reversed(order):
        inside = (len(p.strip()) if isinstance(p, str) else chars[id(p)] for p in node.parts)
        chars[id(node)] = sum(inside) if node.tag == "form" or not node.other else 0
    for node in order:
        if node.tag == "form" and 2 * chars[id(node)] > chars[id(top)]:
            node.other = False


def _prune(top: Node) -> None:
    """Takes marked nodes out, and page headers; a marked block around the main heading stays."""
    order = _in_order(top)
    _unwrap_forms(top, order)
    holds: set[int] = set()
    for node in reversed(order):
        if node.tag in ("h1", "main") or id(node) in holds:
            if node.parent is not None:
                holds.add(id(node.parent))
    for node in order:
        inside, here = False, node.parent
        while node.tag == "header" and here is not None and not inside:
            inside, here = here.tag in ("article", "main"), here.parent
        # An article's own header is kept if it bears the heading.
        if node.tag == "header" and not (inside and id(node) in holds):
            node.other = True
        elif node.tag not in LEFT_OUT and id(node) in holds:
            node.other = node.named = False
    for node in order:
        node.parts = [p for p in node.parts if isinstance(p, str) or not p.other]
    _weigh_names(top)


def _weigh_names(top: Node) -> None:
    """Takes out what a class or id speaks against, unless densities say that it is the article."""
    if not any(x.named for x in _in_order(top)):
        return
    order = _measure(top)
    # The page's own article or main elements go before anything that a name speaks against.
    free: dict[int, bool] = {}
    main = []
    for node in order:
        free[id(node)] = not node.named and (node.parent is None or free[id(node.parent)])
        if node.tag in ("article", "main") and free[id(node)] and node.chars:
            main.append(node)
    best = here = max(map(_core, main), key=lambda x: x.total) if main else _core(top)
    threshold = min(best.density, top.density)
    while here is not None:
        here.named = False
        if here.parent is not None:
            threshold = min(threshold, here.density)
        here = here.parent
    inside, todo = [], [best]
    while todo:
        x = todo.pop()
        if x.named:
            inside.append(x)
        else:
            todo += [p for p in x.parts if isinstance(p, Node)]
    if 2 * sum(x.chars for x in inside) > best.chars:
        for x in inside:
            frames = _in_order(x)
            if max(y.density for y in frames) >= threshold > 0:
                # With the frames within it that hold most of its text.
                for y in frames:
                    y.named = y.named and 2 * y.chars <= x.chars
    for node in order:
        node.parts = [p for p in node.parts if isinstance(p, str) or not p.named]


def _measure(top: Node) -> list[Node]:
    order = _in_order(top)
    linked = set()
    for node in order:
        node.chars = node.link_chars = node.link_tags = 0
        node.tags = 1 + node.raw
        if node.tag == "a" or node.parent is not None and id(node.parent) in linked:
            linked.add(id(node))
    for node in reversed(order):
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        node.chars += own
        if id(node) in linked:
            node.link_chars += own
            node.link_tags += 1
        if node.parent is not None:
            for figure in ("chars", "tags", "link_chars", "link_tags"):
                setattr(node.parent, figure, getattr(node.parent, figure) + getattr(node, figure))
    body_chars, body_links = max(top.chars, 1), top.link_chars
    for node in order:
        c, t, lc, lt = node.chars, node.tags, node.link_chars, node.link_tags
        if c == 0:
            node.density = 0.0
            continue
        base = math.log(c * lc / max(c - lc, 1) + body_links * c / body_chars + math.e)
        adjusted = math.log(max(c * t / (max(lc, 1) * max(lt, 1)), 1.0))
        node.density = c / t * adjusted / math.log(max(base, 1.0) + 1.0)
    for node in order:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node))
    return order


def _core(node: Node) -> Node:
    """The node of largest density sum in a subtree; one without children stands for itself."""
    best = node
    for x in _in_order(node):
        if x.total > best.total:
            best = x
    return best


def chosen(top: Node) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    order = _measure(top)
    if not top.chars:
        return []
    best = _core(top)
    threshold, path, here = math.inf, set(), best
    lifted = None
    while here is not None:
        path.add(id(here))
        if here.parent is not None or here is best:
            threshold = min(threshold, here.density)
        if here.tag == "article" or here.tag == "main" and lifted is None:
            lifted = here
        here = here.parent
    if lifted is not None:
        best = lifted
    threshold = min(threshold, top.density)
    found, skip = [], set()
    for node in order:
        if node.parent is not None and id(node.parent) in skip:
            skip.add(id(node))
        elif node is best:
            found.append(node)
            skip.add(id(node))
        elif id(node) not in path and node.tag in BLOCKS and node.density >= threshold > 0:
            found.append(node)
            skip.add(id(node))
    return found


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks, in page order, without empty ones."""
    found: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(line)).split())
        line.clear()
        if text:
            found.append(text)

    for root in nodes:
        flush()
        todo: list[Node | str | None] = [root]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            else:
                if x.tag in BLOCKS:
                    flush()
                    todo.append(None)
                elif x.tag == "br":
                    line.append(" ")
                todo += reversed(x.parts)
    flush()
    return found


def main_text(html: str | None) -> str:
    top = tree(html or "")
    _prune(top)
    return "\n\n".join(blocks(chosen(top)))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    let_workers_import(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"].to_pylist()]
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long"
    )
