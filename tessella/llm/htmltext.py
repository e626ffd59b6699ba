"""Main text of web pages by tree scoring.

A tolerant single pass, linear in the page however deep it nests, builds a light tree.  Elements that
are never content (menus, scripts, adverts, comments ...) fall away; a form, or an element with a
telling name, falls away unless it holds most of the page's running text (and no article stands outside it), or
is a section of the article.
Every paragraph gives points for its length and commas to its ancestors, less at each level; an element's
points are discounted by its link density.  The best container, widened to an enclosing article, and
those siblings that look alike are kept, with all their text.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows, str_texts

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|<[!?/A-Za-z][^>]*+\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z]+")

#: Fixed values of HTML: elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html tbody td tfoot th thead tr dd dt li legend summary".split()) | frozenset(["summary"])
#: An element of the left kind ends an open one of the right kinds, unless a boundary lies between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
BOUNDARY = frozenset("ul ol dl table select article section div body html main nav".split())
#: Never part of an article's text.
DROP = frozenset("head script style noscript template nav aside footer button select textarea input iframe object embed svg canvas audio video dialog menu label map applet noembed noframes".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tablist".split())
#: Words in class or id of what is never the article.
NEVER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr popup popups modal overlay newsletter comment comments disqus respond reply replies".split())
#: Words of what is not the article, but where a page has nothing else.
DROP_WORDS = frozenset("notice notices alert subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing recommended recommendations footer masthead toolbar login search skip".split())
#: Words that wrappers and sections of articles have too: they count less.
WEAK_WORDS = frozenset("discussion social related widget widgets header tags".split())
#: After "related": a section on the literature.
_LITERATURE = frozenset("work works research literature methods".split())
_SAFE = frozenset("html body article main".split())
#: Pieces of text this long, outside links, are running text.
RUNNING = 25
#: An element's points reach so many of its ancestors.
LEVELS = 64
#: What becomes of an element: kept; dropped; dropped unless the page has no text outside such elements; dropped unless most running text is in it.
KEEP, NEVER, STRONG, WEAK = range(4)


class Node:
    __slots__ = ("tag", "up", "kids", "drop", "role", "points", "chars", "linked", "running", "article", "has_block")

    def __init__(self, tag: str, up: Node | None, drop: int = KEEP, role: str = ""):
        self.tag, self.up, self.drop, self.role = tag, up, drop, role
        self.kids: list = []
        self.points, self.chars, self.linked, self.has_block = 0.0, 0, 0, False
        self.running, self.article = 0, 0


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _unwanted(tag: str, attrs: dict[str, str], inside: bool) -> int:
    if tag in DROP:
        return NEVER
    if tag == "header" and not inside:
        return NEVER
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return NEVER if tag not in ("html", "body") else KEEP
    if attrs.get("role", "").lower() in DROP_ROLES and tag not in ("html", "body"):
        return WEAK if attrs["role"].lower() == "form" else STRONG
    if tag in ("html", "body", "main"):
        return KEEP
    plain = WEAK if tag in ("form", "fieldset") else KEEP
    if not (words := attrs.get("class", "") + " " + attrs.get("id", "")).strip():
        return plain
    found = _WORD.findall(words.lower())
    never, strong, weak = (words.intersection(found) for words in (NEVER_WORDS, DROP_WORDS, WEAK_WORDS))
    if "related" in weak and _LITERATURE.intersection(found):
        weak -= {"related"}
    if tag == "article":  # an article is only dropped as a comment or an advert
        return NEVER if (never | weak) & {"comment", "comments", "reply", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "related"} else KEEP
    if inside:
        weak -= {"header"}  # of the article itself
        if tag == "section":
            weak -= {"discussion"}
    if {"has", "with", "no"}.intersection(found):  # names such as "has-sidebar" of a large wrapper
        return plain
    return NEVER if never else STRONG if strong else WEAK if weak else plain


class _Open:
    """The open elements, with the places of those kinds that decide what a tag closes."""

    def __init__(self, root: Node):
        self.stack, self.by_tag = [root], {}
        self.boundaries, self.blocks, self.articles = [0], [0], 0

    def push(self, node: Node) -> None:
        i, tag = len(self.stack), node.tag
        self.stack.append(node)
        self.by_tag.setdefault(tag, []).append(i)
        if tag in BOUNDARY:
            self.boundaries.append(i)
        if tag in BLOCK and tag != "p":
            self.blocks.append(i)
        self.articles += tag in ("article", "main")

    def close_to(self, i: int) -> None:
        for node in self.stack[i:]:
            self.articles -= node.tag in ("article", "main")
            self.by_tag[node.tag].pop()
        del self.stack[i:]
        for at in (self.boundaries, self.blocks):
            while at[-1] >= i:
                at.pop()

    def last(self, tag: str) -> int:
        at = self.by_tag.get(tag)
        return at[-1] if at else 0

    def end(self, tag: str) -> None:
        """An end tag closes its element; formatting does not close what surrounds its block."""
        i = self.last(tag)
        if i and (tag in BLOCK or i > max(self.blocks[-1], self.last("p"))):
            self.close_to(i)

    def implied_ends(self, tag: str) -> None:
        ends = ENDS.get(tag, ())
        while True:
            i = max((self.last(t) for t in (*ends, *(("p",) if tag in CLOSES_P else ()))), default=0)
            if i <= (self.boundaries[-1] if ends else max(self.boundaries[-1], self.blocks[-1])):
                return
            was = self.stack[i].tag
            self.close_to(i)
            if was == "p":
                return


def parse(html: str) -> Node:
    """Tree of the page; text pieces are strings among a node's children."""
    root = Node("#root", None)
    opened, pos, n = _Open(root), 0, len(html)
    stack = opened.stack
    while pos < n:
        m = _TAG.search(html, pos)
        if m is None:
            stack[-1].kids.append(unescape(html[pos:]))
            break
        if m.start() > pos:
            stack[-1].kids.append(unescape(html[pos : m.start()]))
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "br":
                stack[-1].kids.append(Node("br", stack[-1]))
            else:
                opened.end(tag)
            continue
        if tag in CLOSES_P or tag in ENDS:
            opened.implied_ends(tag)
        at = stack[-1]
        raw_attrs = m[3] or m[6] or ""
        attrs = attributes(raw_attrs) if raw_attrs.strip(" /\n\t") else {}
        node = Node(tag, at, _unwanted(tag, attrs, opened.articles > 0), attrs.get("role", "").lower())
        at.kids.append(node)
        if tag in VOID or (raw_attrs.endswith("/") and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, pos)
            body_end = end.start() if end else n
            node.kids.append(html[pos:body_end])
            close = html.find(">", body_end)
            pos = close + 1 if end and close >= 0 else n
            continue
        opened.push(node)
    return root


def _settle(root: Node) -> None:
    """Decide about elements with telling names by where the page's running text is."""
    order, todo, plain = [], [(root, False, False, False)], 0
    within = set()  # elements inside an article
    while todo:
        x, linked, inside, suspect = todo.pop()
        if x.drop == NEVER:
            continue
        order.append(x)
        if inside:
            within.add(id(x))
        linked, inside, suspect = linked or x.tag == "a", inside or x.tag in ("article", "main"), suspect or x.drop != KEEP
        for k in x.kids:
            if not isinstance(k, str):
                todo.append((k, linked, inside, suspect))
            elif not linked and (t := k.strip()):
                x.running += len(t) if len(t) >= RUNNING else 0
                x.article += len(t) if inside else 0
                plain += 0 if suspect else len(t)
    for x in reversed(order):
        if x.up is not None:
            x.up.running += x.running
            x.up.article += x.article
    for x in order:
        most = 2 * x.running > root.running
        if (x.drop == WEAK and most and (id(x) in within or x.article == root.article)) or (x.drop == STRONG and most and not plain):
            x.drop = KEEP


def _score(root: Node) -> list[Node]:
    """Points of every element that is kept, in page order; fills sizes and link sizes."""
    order: list[Node] = []
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        x, linked = todo.pop()
        order.append(x)
        linked = linked or x.tag == "a"
        for k in reversed(x.kids):
            if isinstance(k, str):
                size = len(k.strip())
                x.chars += size
                x.linked += size if linked else 0
            elif not k.drop:
                todo.append((k, linked))
    commas = {}
    for x in reversed(order):
        commas[id(x)] = sum(k.count(",") + k.count("、") + k.count("，") for k in x.kids if isinstance(k, str))
        for k in x.kids:
            if not isinstance(k, str) and not k.drop:
                x.chars += k.chars
                x.linked += k.linked
                commas[id(x)] += commas[id(k)]
                if k.tag in BLOCK or k.has_block:
                    x.has_block = True
    for x in order:
        own = x.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "td", "dd", "li") or (x.tag in ("div", "section", "article", "main", "body") and any(isinstance(k, str) and len(k.strip()) >= 20 for k in x.kids))
        if not own or x.has_block and x.tag in ("td", "dd", "li", "blockquote") or not x.chars:
            continue
        share = 1 - x.linked / x.chars
        points = (1 + commas[id(x)] + x.chars / 100) * share
        if x.tag in ("li", "td", "dd", "h1", "h2", "h3", "h4", "h5", "h6"):
            points *= 0.3
        up, weight = (x.up if x.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "td", "dd", "li") else x), 1.0
        level = 0
        while up is not None and level < LEVELS:
            up.points += points * weight
            level += 1
            weight = 0.5 if level == 1 else 1 / (3 * level)
            up = up.up
    return order


def _value(x: Node) -> float:
    return x.points * (1 - x.linked / x.chars) if x.chars else 0.0


def main_nodes(root: Node) -> list[Node]:
    """The best container, or it and its like siblings, in page order."""
    _settle(root)
    order = _score(root)
    box = [x for x in order if x.tag in ("div", "section", "article", "main", "body", "td", "center", "blockquote", "#root", "ul", "ol", "dl", "table", "html", "span", "dd", "li", "figure", "details")]
    best = max(box, key=_value, default=root)
    while best.tag in ("ul", "ol", "dl", "table", "td", "li", "dd", "blockquote", "figure", "span") and best.up is not None:
        best = best.up
        while best.up is not None and best.tag not in ("div", "section", "article", "main", "body", "#root", "html"):
            best = best.up
    up = best.up
    while up is not None:  # an article, or main element, is kept as one
        if up.tag in ("article", "main") or up.role in ("article", "main"):
            best = up
        up = up.up
    if best.tag in ("body", "html", "#root", "main", "article") or best.up is None:
        return [best]
    while best.up.tag == "div" and _value(best.up) >= 0.75 * _value(best):
        best = best.up
    least = max(3.0, 0.2 * _value(best))
    out = []
    for k in best.up.kids:
        if isinstance(k, str) or k.drop:
            continue
        if k is best or _value(k) >= least:
            out.append(k)
        elif k.tag in ("p", "pre", "blockquote", "h1", "h2", "h3") and k.chars and k.linked / k.chars < 0.25:
            out.append(k)
    return out


def _menu(x: Node) -> bool:
    """A list, or block of short links, of a page without a container of its own for the article."""
    return x.tag in ("ul", "ol", "div", "table", "p", "section") and x.chars > 0 and x.linked / x.chars > 0.8 and sum(1 for k in x.kids if not isinstance(k, str)) > 1


def blocks(nodes: list[Node]) -> list[str]:
    """Text of every block in page order: white space as one space, trimmed, empty blocks left out.  Two line breaks in a row end a block; one is white space."""
    out: list[str] = []
    held: list[str] = []
    breaks = 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    for node in nodes:
        todo: list = [node]
        loose = node.tag in ("body", "html", "#root")
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                if x.strip():
                    breaks = 0
                held.append(x)
            elif x.drop:
                continue
            elif x.tag == "br":
                breaks += 1
                held.append(" ")
                if breaks > 1:
                    flush()
            else:
                if x.tag in BLOCK:
                    if loose and x is not node and _menu(x):
                        continue
                    flush()
                    breaks = 0
                    todo.append(None)
                todo.extend(reversed(x.kids))
        flush()
    return out


def main_text(html: str) -> str:
    """The page's main text, blocks joined by newlines; empty if there is none."""
    return "\n".join(blocks(main_nodes(parse(html)))) if html else ""


def extract(pages: DataFrame, html_col: str = "html", text_name: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the main text to every row.  Null or empty html, and pages without text, give the empty text; whole pages are read, and repeated rows stay.  A column that is already called ``text_name`` is replaced."""

    def make():
        return lambda html: [pa.array(map(main_text, str_texts(html)), pa.string())]

    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() != text_name.lower()]
    return map_rows(pages, [html_col], [(text_name, T.StringType())], make, keep=keep)
