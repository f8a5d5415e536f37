"""A tolerant scanner that turns markup into blocks of text with their place in the element tree.

Its time is in proportion to the page: every search goes on from where the last one ended, what is known to occur no
more is not looked for again, and open elements are kept by kind.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text that a reader of the page sees, or belongs to a form.
RAW = frozenset("script style textarea title noscript template iframe select datalist noframes desc metadata".split())
#: Of those, the ones that a slash in their start tag ends.
FOREIGN = frozenset("desc metadata".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the first closes an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: May stand in a head; the start of any other element ends it, as text does.
HEAD = frozenset("head base basefont bgsound link meta title noscript noframes script style template html".split())
SCOPES = frozenset("article aside body div dl footer form header main nav ol section table td th ul".split())
FURNITURE = frozenset("nav menu footer aside form dialog button fieldset label search".split())
FURNITURE_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog alert menu menubar".split())

# Names of classes and ids that speak against text, and for it.
BAD_NAMES = (
    re.compile(r"(?:^|[-_ ])(?:nav\w*|menu\w*|breadcrumb\w*|pagination|pager|toc|skip(?:-?link)?)(?=$|[-_ ])"),
    re.compile(r"(?:^|[-_ ])(?:footer\w*|foot|copyright|colophon|legal|imprint)(?=$|[-_ ])"),
    re.compile(r"(?<!article-)(?<!post-)(?<!entry-)(?<!story-)(?:^|\b|[_ ])(?:masthead|topbar|header|banner\w*|logo)(?=$|[-_ ])"),
    re.compile(r"(?:^|[-_ ])(?:side-?bar\w*|aside|rail|widget\w*|related|recommend\w*|trending|popular|more-?(?:news|stories|posts)|tags?)(?=$|[-_ ])"),
    re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|ad(?:box|slot|sense|banner|unit|wrap\w*)|sponsor\w*|promo\w*|commercial|affiliate|cta)(?=$|[-_ ])"),
    re.compile(r"(?:^|[-_ ])(?:cookie\w*|consent|gdpr|privacy|notices?|notifications?|alerts?|pop-?(?:up|over)\w*|modal\w*|overlay|newsletter\w*|subscri\w*|paywall|sign-?up|log-?in|toast)(?=$|[-_ ])"),
    re.compile(r"(?:^|[-_ ])(?:shar(?:e|ing)\w*|social\w*|follow|buttons?|toolbar|search\w*|forms?)(?=$|[-_ ])"),
)
COMMENT_NAMES = re.compile(r"(?:^|[-_ ])(?:comment\w*|disqus\w*|repl(?:y|ies)|respond|discussion)(?=$|[-_ ])")
GOOD_NAMES = re.compile(r"(?:^|[-_ ])(?:article|post|entry|story|content|main|body|text)(?:-?(?:body|content|text))?(?=$|[-_ ])")

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: A slash at a tag's end that is not the end of a value.
_EMPTY = re.compile(r"(?:^|[\s\"'])/\s*\Z")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int
    furniture: bool = False  # by tag, role or hiding; of it or an ancestor
    header: bool = False  # a page's header, not an article's; of it or an ancestor
    article: bool = False  # it or an ancestor is the article or main part of something
    chief: bool = False  # it is
    good: bool = False  # its names speak for text
    bad: bool = False  # its names speak against text; once settled: its own or an ancestor's, as far as they count
    comments: bool = False  # they speak of comments
    chars: int = 0  # of text in it and its descendants


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    link_chars: int


@dataclass(slots=True)
class Page:
    blocks: list[Block]
    main: Element | None  # the element that is its main part, if one is marked so and holds a good part of the text


def _element(tag: str, parent: Element, attributes: str) -> Element:
    e = Element(tag, parent, parent.depth + 1, parent.furniture or tag in FURNITURE, parent.header or tag == "header" and not parent.article, parent.article)
    e.chief = tag in ("article", "main")
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value, name = _CAMEL.sub("-", a or b or c).lower(), name.lower()
            if name in ("class", "id"):
                e.comments |= bool(COMMENT_NAMES.search(value))
                e.bad |= e.comments or any(p.search(value) for p in BAD_NAMES)
                e.good |= bool(GOOD_NAMES.search(value))
            elif name == "role":
                e.furniture |= value in FURNITURE_ROLES
                e.header |= value == "banner"
                e.chief |= value in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDING.search(value):
                e.furniture = True
    e.article |= e.chief
    return e


class _Source:
    """The page, with searches that remember what doesn't come any more."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag whose attributes start at at has its ">": quotes after "=" hide it, if they are closed. -1 if
        there is none."""
        page, first = self.page, self.find(">", at)
        if first < 0:
            return -1
        sign = page.find("=", at, first)
        here, end = at, first
        while sign >= 0:
            here = sign + 1
            while here < len(page) and page[here].isspace():
                here += 1
            if here < len(page) and page[here] in "\"'":
                close = self.find(page[here], here + 1)
                if close < 0:
                    return end if end >= here else self.find(">", here)
                here = close + 1
                if here > end:
                    end = self.find(">", here)
                    if end < 0:
                        return first  # a quote that is closed somewhere else: the tag ends where it seems to
            sign = page.find("=", here, end)
        return end

    def raw_end(self, tag: str, at: int) -> int:
        """What follows the end tag of an element whose content is not markup, or the end of the page."""
        pattern = _raw_end(tag)
        m = pattern.search(self.page, at)
        close = self.find(">", m.end()) if m else -1
        return close + 1 if close >= 0 else len(self.page)


_RAW_ENDS: dict[str, re.Pattern] = {}


def _raw_end(tag: str) -> re.Pattern:
    if tag not in _RAW_ENDS:
        _RAW_ENDS[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)
    return _RAW_ENDS[tag]


class _Open:
    """The open elements, innermost last, and the places of those of each tag, of blocks and of scopes."""

    def __init__(self, root: Element):
        self.stack = [root]
        self.of_tag: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def push(self, e: Element) -> None:
        at = len(self.stack)
        self.stack.append(e)
        self.of_tag[e.tag].append(at)
        if e.tag in BLOCKS:
            self.blocks.append(at)
        if e.tag in SCOPES:
            self.scopes.append(at)

    def close(self, at: int) -> None:
        """Closes the element at that place and all within it."""
        while len(self.stack) > at:
            e = self.stack.pop()
            self.of_tag[e.tag].pop()
            if e.tag in BLOCKS:
                self.blocks.pop()
            if e.tag in SCOPES:
                self.scopes.pop()

    def last(self, tags) -> int:
        return max((self.of_tag[t][-1] for t in tags if self.of_tag[t]), default=0)

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0

    def block(self) -> Element:
        return self.stack[self.blocks[-1]] if self.blocks else self.stack[0]


def parse(page: str) -> Page:
    """The page's blocks in order: text without markup, references decoded, white space run together, none empty."""
    source, size = _Source(page), len(page)
    out: list[Block] = []
    elements: list[Element] = []
    root = Element("", None, 0)
    open_ = _Open(root)
    owner, parts, links = root, [], []
    anchors, at, in_head = 0, 0, False

    def end_block() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, owner, len(" ".join(html.unescape("".join(links)).split())) if links else 0))
            parts, links = [], []

    def add(text: str) -> None:
        nonlocal owner, in_head
        if in_head and text.strip():
            in_head = False
        if text and not in_head:
            if not parts:
                owner = open_.block()
            parts.append(text)
            if anchors:
                links.append(text)

    while at < size:
        less = source.find("<", at)
        if less < 0:
            add(page[at:])
            break
        if less > at:
            add(page[at:less])
        at = less
        if page.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        closing = page.startswith("</", at)
        name = _TAG_NAME.match(page, at + 1 + closing)
        if name is None:
            if page[at + 1 : at + 2] in ("!", "?", "/") and page[at + 1 : at + 2]:
                end = source.find(">", at)
                if end >= 0:
                    at = end + 1
                    continue
            add("<")
            at += 1
            continue
        end = source.tag_end(name.end())
        if end < 0:  # no tag ends any more: what is left is text
            add(page[at:])
            break
        tag, attributes, at = name[0].lower(), page[name.end() : end], end + 1
        if closing:
            if tag == "head":
                in_head = False
                continue
            if tag in BLOCKS:
                end_block()
            if tag == "a" and anchors:
                anchors -= 1
            place = open_.last((tag,))
            if place and (tag in BLOCKS or place >= open_.scope()):  # a stray end of an inline element ends no block
                open_.close(place)
            continue
        if tag == "head":
            in_head = not out and not "".join(parts).strip()  # in the body it means nothing
            continue
        if tag not in HEAD:
            in_head = False
        if tag in RAW and not (tag in FOREIGN and _EMPTY.search(attributes)):
            at = source.raw_end(tag, at)
            continue
        if tag in ("br", "wbr", "img"):
            if parts and tag == "br":
                add(" ")
            continue
        if tag in BLOCKS:
            end_block()
            if open_.stack[-1].tag == "p" or tag in CLOSES:
                place = open_.last(CLOSES.get(tag, set()) | {"p"})
                if place and place >= open_.scope():
                    open_.close(place)
            elif open_.block().tag == "p":
                open_.close(open_.blocks[-1])
        if tag in VOID or tag not in BLOCKS and _EMPTY.search(attributes):
            continue
        if tag == "a":
            anchors = 1
        elif tag in BLOCKS:
            anchors = 0 if tag not in ("li", "td", "div") else anchors
        elements.append(_element(tag, open_.stack[-1], attributes))
        open_.push(elements[-1])
    end_block()
    return Page(out, _settle(elements, out))


def _settle(elements: list[Element], found: list[Block]) -> Element | None:
    """Finds the main part, and hands bad names down from parents to children. A name like "has-sidebar" on an element that
    holds the page's main part, or most of its text, speaks of the page and not of its text, so it isn't counted there."""
    for b in found:
        b.element.chars += len(b.text)
    for e in reversed(elements):
        e.parent.chars += e.chars
    total = sum(len(b.text) for b in found)
    best = _largest(elements, total)
    holders = set()
    x = best
    while x is not None:
        holders.add(id(x))
        x = x.parent
    for e in elements:
        wide = 2 * e.chars > total
        spared = e.tag in ("html", "body", "main", "article") or (wide and (best is None or id(e) in holders) if e.comments else wide or id(e) in holders)
        e.bad = e.parent.bad or e.bad and not spared
        e.good |= e.parent.good
    return _largest([e for e in elements if not e.bad], total)


def _largest(elements: list[Element], total: int) -> Element | None:
    """The element marked as a main part that has most text, if it has a good part of all."""
    return max((e for e in elements if e.chief and not e.furniture and 4 * e.chars >= total), key=lambda e: e.chars, default=None)


def distance(a: Element, b: Element, most: int) -> int:
    """Steps between two elements of the tree, most if there are more."""
    n = 0
    while a is not b and n < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n
