"""Main text of web pages by two-pass block rules.

A scanner cuts a page into blocks at block-level tags and notes, for each, its length, stop-word density, link density and the element
it stands in. Elements say of themselves whether they are an aside (a menu, header, footer, sidebar, form, ...), whether their
class, id or role marks them (as an advert, notice, comment section, ...) or hides them, and whether they are an article.

Pass 1 decides clear blocks. Bad are blocks in an aside or in a marked or hidden element, blocks outside the articles of a page that has
any, and elsewhere blocks mostly of links and long blocks nearly without stop words. Good are long blocks of many stop words. All others are ambiguous: short blocks,
and long ones with some stop words.
Pass 2 gives each ambiguous block the label of its nearest decided neighbours; between neighbours that differ the nearer one counts, at equal
distance the good one. Neighbours are looked for among the blocks that no element rules out, as what a menu or a footer holds says nothing of the text beside
it; so in a page with articles only blocks inside are neighbours of each other, and what the rules leave open there is part of the
article, as is a page's text if nothing in it is clear.

An article inside an aside or a marked element is part of that (a comment or a teaser), unless all articles of the page are: then what holds them says
nothing. In the same way a form or what a class marks says nothing if it is around all blocks of a page of several.

Cases. Null or empty html: empty text. Markup that never closes: the rest of the page belongs to it, unless
an outer element closes; end tags that may be left out (of p, li, dd, dt, tr, td, th, option, head) are implied. Null url or id: passed through. Repeated pages get equal texts.
Extra columns are ignored, whatever their names. A very long page is a batch of its own; time and memory are in proportion to its length, however deep elements are nested. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_frames

#: Frequent function words of English, French, German and Spanish; a choice.
STOP_WORDS = frozenset("""
the of and to a in is it that for on as with was be by are this or at from
le la les de des du et en un une que qui est dans pour par sur au pas avec elle
der die das und den von zu mit ist im dem nicht ein eine als auch sich auf für
el los las y con no se su del al lo como más
""".split())  # fmt: skip
#: Elements whose text is never shown as text.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""
address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary
table tbody td tfoot th thead tr ul
""".split())  # fmt: skip
#: Elements that hold no article text; a header does so outside an article.
ASIDE = frozenset("nav footer aside form menu dialog button select search head".split())
#: Which open elements a start tag ends, up to an element of the second kind.
LISTS = frozenset("ul ol menu dir".split())
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot"]), frozenset(["table"])),
    "thead": (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
}
#: Names in class, id or role that mark an element; a compound name does if each of its words is one of these or of ``PLACES``.
MARKS = frozenset("""
ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr
notice notification notifications alert toast popup modal overlay newsletter subscribe subscription signup login paywall sidebar
related recommended recommendations teaser teasers share sharing menu nav navbar navigation topnav breadcrumb breadcrumbs topbar
masthead footer contentinfo complementary comment comments commentlist disqus respond replies reply copyright
disclaimer pagination pager toolbar searchbox dialog hidden
""".split())  # fmt: skip
PLACES = frozenset("""
site page global main top bottom left right side box block wrap wrapper container inner outer list area section widget bar item items link links
unit slot text content body header post posts story stories article articles form social media thread user policy law and the of in my a b c
primary secondary small large mobile desktop js fixed sticky
""".split())  # fmt: skip
#: These names mark elements outside articles only.
HEADERS = frozenset("header banner masthead".split())
LONG, MANY_STOPS, FEW_STOPS, MANY_LINKS = 70, 0.2, 0.04, 0.5
#: Characters in which a tag's end is looked for outside quotes.
TAG = 1 << 14

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^a-z]+")


@dataclass(eq=False)
class Element:
    """An open or closed element; ``says`` is what it says of itself, ``is_`` what holds with all around it."""

    name: str
    up: Element | None
    aside: bool = False
    marked: bool = False
    hidden: bool = False
    article: bool = False
    in_article: bool = False  # an article, or inside one, by tags alone
    off: bool = False  # with all around it: an aside, marked or hidden
    own_article: bool = False  # with all around it: inside an article that is not off
    blocks: int = 0


@dataclass(eq=False)
class Block:
    text: str
    link_share: float
    holder: Element | None
    label: str = field(default="ambiguous")
    by: int = 0  # the pass that decided


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case, and values with references decoded; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def names_mark(names: str, in_article: bool) -> bool:
    """Whether one of the names, set apart by white space, marks an element."""
    known = MARKS | (frozenset() if in_article else HEADERS)
    known -= HEADERS if in_article else frozenset()
    for name in names.lower().split():
        words = [w for w in _SPLIT.split(name) if w]
        if any(w in known for w in words) and all(w in known or w in PLACES for w in words):
            return True
    return False


def element(name: str, raw: str, up: Element | None) -> Element:
    inside = up is not None and up.in_article
    said = attributes(raw) if raw and not raw.isspace() else {}
    hidden = "hidden" in said and said["hidden"] != "false" or said.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(said.get("style", "")))
    marked = name not in ("html", "body") and any(names_mark(said[k], inside) for k in ("class", "id", "role") if k in said)
    article = name in ("article", "main") or said.get("role", "").lower() in ("article", "main")
    return Element(name, up, name in ASIDE or (name == "header" and not inside), marked, hidden, article, inside or article)


def tag_at(html: str, at: int) -> tuple[bool, str, str, int] | None:
    """(whether it closes, name, attributes, end) of the tag at ``at``; None if there is none."""
    end = html.find(">", at)
    if end < 0 or not (html[at + 1 : at + 2].isalpha() or (html[at + 1 : at + 2] == "/" and html[at + 2 : at + 3].isalpha())):
        return None
    part = html[at : end + 1]
    if ('"' in part or "'" in part) and (m := _TAG.match(html[at : at + TAG])):
        return bool(m[1]), m[2].lower(), m[3], at + m.end()
    closes = part[1] == "/"
    name = re.match(r"[^\s/>]+", part[1 + closes :])[0]
    return closes, name.lower(), part[1 + closes + len(name) : -1], end + 1


class Scanner:
    """The blocks and elements of a page, in one pass."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.elements: list[Element] = []
        self.stack: list[Element] = []
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.off: list[str] = []  # open inline elements from a marked or hidden one on
        self._scan(html)
        self._end_block()

    def _end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            holder = self.stack[-1] if self.stack else None
            self.blocks.append(Block(text, min(1.0, self.linked / len(text)), holder))
            if holder:
                holder.blocks += 1
        self.parts.clear()
        self.linked = 0

    def _push(self, name: str, raw: str) -> None:
        self.stack.append(element(name, raw, self.stack[-1] if self.stack else None))
        self.elements.append(self.stack[-1])
        self.open[name] = self.open.get(name, 0) + 1

    def _pop(self) -> str:
        name = self.stack.pop().name
        self.open[name] -= 1
        return name

    def _close(self, name: str) -> None:
        if self.open.get(name):
            while self._pop() != name:
                pass

    def _imply(self, name: str) -> None:
        """End the elements whose end tags the start of ``name`` implies."""
        if self.open.get("p"):  # nothing of block level is inside a paragraph
            self._close("p")
        if name != "head" and self.open.get("head"):
            self._close("head")
        ended, until = ENDS.get(name, ((), ()))
        if any(self.open.get(e) for e in ended):
            last = next((k for k in range(len(self.stack) - 1, max(-1, len(self.stack) - 64), -1) if self.stack[k].name in until), None)
            first = next((k for k in range((last if last is not None else max(-1, len(self.stack) - 64)) + 1, len(self.stack)) if self.stack[k].name in ended), None)
            while first is not None and len(self.stack) > first:
                self._pop()

    def _scan(self, html: str) -> None:
        at, in_link, breaks = 0, 0, 0
        while at < len(html):
            less = html.find("<", at)
            text = html[at:] if less < 0 else html[at:less]
            if text and not self.off:
                text = unescape(text) if "&" in text else text
                if not text.isspace():
                    breaks = 0
                    if self.open.get("head"):  # text that is shown starts the body
                        self._close("head")
                if in_link:
                    self.linked += len(text.strip())
                self.parts.append(text)
            if less < 0:
                return
            if html.startswith("<!--", less):
                end = html.find("-->", less + 4)
                at = len(html) if end < 0 else end + 3
                continue
            tag = tag_at(html, less)
            if not tag:
                if html[less + 1 : less + 2] in ("!", "?", "/") or html[less + 1 : less + 2].isalpha():
                    end = html.find(">", less)
                    at = len(html) if end < 0 else end + 1
                else:
                    if not self.off:
                        self.parts.append("<")
                    at = less + 1
                continue
            closes, name, raw, at = tag
            if name in RAW:
                if not closes and not raw.endswith("/"):
                    end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(html, at)
                    at = end.end() if end else len(html)
            elif name == "br":
                breaks += 1
                self.parts.append(" ")
                if breaks > 1:
                    self._end_block()
            elif name in BLOCK:
                self._end_block()
                breaks = in_link = 0
                self.off.clear()
                if name in VOID:
                    self._imply(name)
                elif closes:
                    self._close(name)
                else:
                    self._imply(name)
                    self._push(name, raw)
            elif name not in VOID:
                if name == "a":
                    in_link = 0 if closes else 1
                self._inline(closes, name, raw)

    def _inline(self, closes: bool, name: str, raw: str) -> None:
        """Text of a marked or hidden inline element is left out, up to its end tag or the end of the block."""
        if self.off:
            if not closes and not raw.endswith("/"):
                self.off.append(name)
            elif closes and name in self.off[-64:]:
                while self.off.pop() != name:
                    pass
        elif not closes and raw and not raw.isspace() and not raw.endswith("/"):
            own = element(name, raw, self.stack[-1] if self.stack else None)
            if own.marked or own.hidden:
                self.off.append(name)
                self.parts.append(" ")


def settle(elements: list[Element], blocks: list[Block]) -> None:
    """``off`` and ``own_article`` of all elements, from the outside in."""
    total = [0] * len(elements)
    place = {id(e): k for k, e in enumerate(elements)}
    for k in range(len(elements) - 1, -1, -1):
        total[k] += elements[k].blocks
        if elements[k].up is not None:
            total[place[id(elements[k].up)]] += total[k]
    shown = len(blocks)

    def spread(ignored: set[int]) -> bool:
        """Whether there is an article that isn't off, if what the elements in ``ignored`` say doesn't count."""
        some = False
        for k, e in enumerate(elements):
            says = (e.aside or e.marked or e.hidden) and k not in ignored
            e.off = says or (e.up is not None and e.up.off)
            e.own_article = not e.off and (e.article or (e.up is not None and e.up.own_article))
            some |= e.own_article and total[k] > 0
        return some

    # what holds all blocks of the page says nothing, unless it is a menu or the like
    around = {k for k, e in enumerate(elements) if shown > 1 and total[k] == shown and (e.name == "form" or not e.aside)}
    if spread(around):
        return
    articles = [k for k, e in enumerate(elements) if e.article and total[k]]
    if articles:  # all are inside something that is off: what holds them says nothing
        holding: set[int] = set()
        for k in articles:
            own = elements[k]
            while own is not None and place[id(own)] not in holding:
                holding.add(place[id(own)])
                own = own.up
        if not spread(around | holding):
            spread(around)


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def decide(blocks: list[Block]) -> None:
    """Pass 1: label the clear blocks."""
    has_article = any(b.holder is not None and b.holder.own_article for b in blocks)
    for b in blocks:
        inside = b.holder is not None and b.holder.own_article
        b.by = 1
        if (b.holder is not None and b.holder.off) or (has_article and not inside):
            b.label = "bad"
        elif b.link_share > MANY_LINKS and not inside:
            b.label = "bad"
        elif len(b.text) >= LONG and b.link_share <= MANY_LINKS and (share := stop_share(b.text)) >= MANY_STOPS:
            b.label = "good"
        elif len(b.text) >= LONG and not inside and share < FEW_STOPS:
            b.label = "bad"
        else:
            b.by = 0


def inherit(blocks: list[Block]) -> None:
    """Pass 2: ambiguous blocks take the label of their nearest decided neighbours in the same part of the page."""
    has_article = any(b.holder is not None and b.holder.own_article for b in blocks)
    part = [b for b in blocks if not (b.holder is not None and b.holder.off) and (b.holder.own_article if has_article and b.holder else not has_article)]
    decided = [b.label if b.by else None for b in part]
    clear = "good" in decided
    before: list[tuple[int, str] | None] = []
    last = None
    for i, label in enumerate(decided):
        last = (i, label) if label else last
        before.append(last)
    after: tuple[int, str] | None = None
    for i in range(len(part) - 1, -1, -1):
        if decided[i]:
            after = (i, decided[i])
            continue
        near = [x for x in (before[i], after) if x]
        part[i].by = 2
        if not near or not clear:
            part[i].label = "good"
        elif len(near) == 2 and near[0][1] != near[1][1]:
            apart = [abs(x[0] - i) for x in near]
            part[i].label = "good" if apart[0] == apart[1] else near[int(apart[1] < apart[0])][1]
        else:
            part[i].label = near[0][1]


def read(html: str | None) -> list[Block]:
    """The page's blocks in order, all decided."""
    page = Scanner(html or "")
    settle(page.elements, page.blocks)
    decide(page.blocks)
    inherit(page.blocks)
    return page.blocks


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in read(html) if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_inherited) of each page: its text, and how many blocks it has and pass 2 decided."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [read(h) for h in pdf["html"]]
            yield pdf[["page_id", "url"]].assign(
                text=["\n".join(b.text for b in own if b.label == "good").encode("utf-8", "replace").decode() for own in found],
                n_blocks=[len(own) for own in found], n_inherited=[sum(b.by == 2 for b in own) for own in found],
            )

    id_type = pages.schema[id_col].dataType.simpleString()
    slim = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    texts = map_frames(slim, run, f"page_id {id_type}, url string, text string, n_blocks long, n_inherited long", "html")
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_inherited")
