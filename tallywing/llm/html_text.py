"""Main text of web pages from flat text blocks and a decision tree.

A page is cut at block tags into flat blocks of text. A block is described by its word count and
link density, those of the blocks before and after it, and where it stands: in an article or main
element, in a part that pages use for menus, headers, footers, sidebars, forms or comments, under a
class or id whose name tells, or may tell, of such a part, or under a heading tag. A decision tree, grown on the small
labelled table below, says whether it belongs to the main text.

Where a block stands is weighed by words: a part that holds most of the page's unlinked words is no
part of its margin, an article is none that holds few of them, and what stands around an article
counts for it only if the page has another one that stands free.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from .common import bounded_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S
)
# Element and attribute names of the HTML standard and of common page templates.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "button", "title", "canvas", "math", "audio", "video"}
#: Of these, what is inside is no markup up to the own closing tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ASIDE = {"nav", "footer", "header", "aside", "menu", "dialog"}
FORMS = {"form", "fieldset"}
MAIN = {"article", "main"}
# Parts of class and id names that tell of reader comments and pop-ups; of menus, notices and adverts; those that do so only beside nothing but other such parts or places; places; those that say that a page has or lacks a part.
READERS = {"cookie", "cookies", "consent", "gdpr", "popup", "modal", "comment", "comments", "disqus", "newsletter", "subscribe", "signup", "login"}
STRONG = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "topbar", "overlay", "pagination", "pager", "copyright", "toolbar"}
WEAK = {"side", "aside", "foot", "header", "notice", "alert", "respond", "reply", "replies", "discussion", "share", "sharing", "social", "related", "recommended", "teaser", "more", "search", "form", "widget", "legal", "disclaimer", "skip"}
PLACE = {"area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "right", "section", "site", "stories", "story", "thread", "title", "to", "top", "wrap", "wrapper"}
LAYOUT = {"no", "non", "not", "without", "has", "have", "with", "is", "free", "layout", "template", "theme", "open", "closed", "off", "on", "disabled", "enabled"}
#: A part with more than this share of the page's unlinked words, and no fewer of them than LEAST_WORDS, is no margin: one named or tagged as such, and a form.
MARGIN, FORM_MARGIN, LEAST_WORDS = 0.8, 0.5, 25
#: An article with less than this share of the words that stand in no margin is a teaser.
LEAST_MAIN = 0.25
ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|alert|dialog|menu", re.I)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s/]|$)""", re.I)
UNSEEN = re.compile(r"""(?:^|\s)style\s*=\s*(?:"[^"]*?display\s*:\s*none|'[^']*?display\s*:\s*none)|(?:^|\s)aria-hidden\s*=\s*["']?true""", re.I)
CLOSES_P = {"p", "div", "ul", "ol", "table", "section", "article", "aside", "nav", "footer", "header", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "main", "hr", "dl"}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "page_has_main", "in_aside", "hinted", "heading")
#: Labelled blocks, as FEATURES and 1 for main text; link densities in 0 to 1.
LABELLED = np.array([
    # article text
    (12, 0.0, 0, 0.0, 80, 0.0, 1, 1, 0, 0, 1, 1), (85, 0.0, 12, 0.0, 60, 0.0, 1, 1, 0, 0, 0, 1), (6, 0.0, 85, 0.0, 0, 0.0, 1, 1, 0, 0, 0, 1), (1, 0.0, 60, 0.0, 60, 0.0, 1, 1, 0, 0, 0, 1),
    (45, 0.1, 30, 0.0, 30, 0.0, 1, 1, 0, 0, 0, 1), (8, 0.0, 5, 1.0, 40, 0.0, 1, 1, 0, 0, 1, 1), (20, 0.3, 40, 0.0, 40, 0.0, 1, 1, 0, 0, 0, 1), (3, 0.0, 4, 0.0, 4, 0.0, 1, 1, 0, 0, 0, 1),
    (300, 0.02, 10, 0.0, 5, 0.9, 1, 1, 0, 0, 0, 1), (5, 1.0, 60, 0.0, 60, 0.0, 1, 1, 0, 0, 0, 1), (2, 1.0, 20, 0.0, 20, 0.1, 1, 1, 0, 0, 0, 1), (14, 0.0, 2, 1.0, 2, 1.0, 1, 1, 0, 0, 0, 1),
    (60, 0.0, 10, 0.0, 50, 0.05, 0, 0, 0, 0, 0, 1), (25, 0.0, 60, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 1), (9, 0.0, 3, 1.0, 55, 0.0, 0, 0, 0, 0, 1, 1), (120, 0.1, 6, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (16, 0.0, 45, 0.0, 40, 0.0, 0, 0, 0, 0, 0, 1), (4, 0.0, 90, 0.0, 70, 0.0, 0, 0, 0, 0, 0, 1), (35, 0.2, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (50, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 1), (28, 0.0, 70, 0.1, 2, 1.0, 0, 0, 0, 0, 0, 1), (75, 0.05, 30, 0.0, 1, 1.0, 0, 0, 0, 0, 0, 1), (40, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 1),
    (2, 0.0, 10, 0.0, 0, 0.0, 1, 1, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 70, 0.0, 1, 1, 0, 0, 1, 1), (7, 0.0, 20, 0.0, 3, 0.0, 1, 1, 0, 0, 0, 1), (1, 0.0, 8, 0.3, 5, 0.0, 1, 1, 0, 0, 0, 1),
    (4, 0.0, 6, 0.0, 1, 1.0, 1, 1, 0, 0, 0, 1), (2, 0.0, 3, 0.0, 9, 0.0, 0, 0, 0, 0, 0, 1), (1, 0.0, 12, 0.0, 6, 0.0, 0, 0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 8, 0.0, 0, 0, 0, 0, 1, 1),
    (2, 0.0, 1, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (6, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 0, 0, 1),
    # titles after a menu
    (5, 0.0, 2, 1.0, 84, 0.0, 0, 0, 0, 0, 1, 1), (3, 0.0, 1, 1.0, 60, 0.0, 0, 0, 0, 0, 1, 1), (6, 0.0, 4, 1.0, 40, 0.1, 0, 0, 0, 0, 1, 1), (2, 0.0, 2, 1.0, 120, 0.0, 0, 0, 0, 0, 1, 1), (4, 0.0, 3, 0.9, 25, 0.0, 0, 0, 0, 0, 1, 1),
    # lists of links inside an article
    (2, 1.0, 30, 0.0, 3, 1.0, 1, 1, 0, 0, 0, 1), (3, 1.0, 2, 1.0, 2, 1.0, 1, 1, 0, 0, 0, 1), (4, 1.0, 3, 1.0, 60, 0.0, 1, 1, 0, 0, 0, 1), (6, 0.9, 5, 1.0, 4, 1.0, 1, 1, 0, 0, 0, 1),
    (12, 0.8, 40, 0.0, 9, 1.0, 1, 1, 0, 0, 0, 1), (1, 1.0, 0, 0.0, 1, 1.0, 1, 1, 0, 0, 0, 1), (3, 1.0, 50, 0.0, 0, 0.0, 1, 1, 0, 0, 0, 1), (25, 0.7, 20, 0.8, 30, 0.9, 1, 1, 0, 0, 0, 1),
    # menus, headers, footers, sidebars, forms
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 14, 0.0, 0, 1, 1, 0, 0, 0), (22, 0.0, 60, 0.0, 0, 0.0, 0, 1, 1, 0, 0, 0),
    (90, 0.0, 80, 0.0, 5, 0.0, 0, 1, 1, 0, 0, 0), (6, 0.0, 0, 0.0, 8, 1.0, 0, 1, 1, 0, 1, 0), (3, 0.4, 2, 1.0, 40, 0.0, 1, 1, 1, 0, 0, 0), (60, 0.1, 9, 0.0, 30, 0.0, 1, 1, 1, 0, 0, 0),
    (5, 1.0, 4, 1.0, 6, 1.0, 0, 0, 1, 0, 0, 0), (40, 0.0, 20, 0.0, 30, 0.0, 0, 0, 1, 0, 0, 0), (4, 0.0, 3, 0.0, 20, 0.0, 0, 0, 1, 0, 1, 0), (12, 0.3, 9, 1.0, 0, 0.0, 0, 0, 1, 0, 0, 0),
    (35, 0.0, 30, 0.0, 40, 0.0, 0, 1, 1, 0, 0, 0), (120, 0.05, 60, 0.0, 20, 0.0, 0, 0, 1, 0, 0, 0), (65, 0.0, 25, 0.0, 15, 0.0, 0, 0, 1, 0, 0, 0), (28, 0.1, 0, 0.0, 90, 0.0, 1, 1, 1, 0, 0, 0),
    (200, 0.0, 10, 0.0, 12, 0.0, 0, 0, 1, 0, 0, 0), (50, 0.0, 70, 0.0, 60, 0.0, 1, 1, 1, 0, 0, 0),
    # notices, adverts, comments, teasers by name of class or id
    (9, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0, 2, 0, 0), (70, 0.0, 5, 0.0, 80, 0.0, 0, 1, 0, 2, 0, 0), (30, 0.1, 80, 0.0, 25, 0.0, 1, 1, 0, 2, 0, 0), (4, 0.0, 60, 0.0, 30, 0.0, 1, 1, 0, 2, 1, 0),
    (18, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0, 2, 0, 0), (55, 0.0, 4, 0.0, 60, 0.0, 0, 0, 0, 2, 0, 0), (3, 1.0, 40, 0.0, 3, 1.0, 0, 0, 0, 2, 0, 0), (110, 0.0, 30, 0.0, 90, 0.0, 1, 1, 0, 2, 0, 0),
    (150, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0, 2, 0, 0), (33, 0.0, 50, 0.0, 45, 0.0, 0, 0, 0, 2, 0, 0), (26, 0.0, 15, 0.0, 60, 0.0, 1, 1, 0, 2, 0, 0), (80, 0.0, 20, 0.0, 0, 0.0, 0, 1, 0, 2, 0, 0),
    # outside the article of a page that marks it
    (7, 0.0, 2, 1.0, 12, 0.0, 0, 1, 0, 0, 0, 0), (45, 0.0, 60, 0.0, 10, 0.0, 0, 1, 0, 0, 0, 0), (3, 1.0, 4, 1.0, 5, 1.0, 0, 1, 0, 0, 0, 0), (10, 0.0, 0, 0.0, 6, 0.0, 0, 1, 0, 0, 1, 0),
    (60, 0.0, 30, 0.0, 20, 0.0, 0, 1, 0, 0, 0, 0), (25, 0.05, 10, 0.0, 80, 0.0, 0, 1, 0, 0, 0, 0), (110, 0.0, 50, 0.0, 3, 0.0, 0, 1, 0, 0, 0, 0), (2, 0.0, 90, 0.0, 0, 0.0, 0, 1, 0, 0, 0, 0),
    # links without any mark
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0), (8, 0.9, 7, 0.9, 9, 1.0, 0, 0, 0, 0, 0, 0), (5, 0.8, 3, 1.0, 60, 0.0, 0, 0, 0, 0, 0, 0),
    (12, 0.7, 50, 0.0, 4, 1.0, 0, 0, 0, 0, 0, 0), (1, 1.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 1, 0),
    # weak names: short or linked blocks are parts of the page, long plain ones are text under an odd name
    (80, 0.0, 5, 0.0, 60, 0.0, 0, 0, 0, 1, 0, 1), (45, 0.0, 30, 0.0, 0, 0.0, 1, 1, 0, 1, 0, 1), (120, 0.05, 9, 0.0, 50, 0.0, 0, 0, 0, 1, 0, 1), (35, 0.1, 80, 0.0, 40, 0.0, 1, 1, 0, 1, 0, 1),
    (150, 0.0, 12, 0.0, 90, 0.1, 1, 1, 0, 1, 0, 1), (60, 0.0, 0, 0.0, 70, 0.0, 0, 0, 0, 1, 0, 1), (90, 0.1, 70, 0.0, 3, 1.0, 0, 0, 0, 1, 0, 1), (48, 0.0, 6, 0.0, 52, 0.0, 1, 1, 0, 1, 0, 1),
    (3, 0.0, 40, 0.0, 60, 0.0, 1, 1, 0, 1, 0, 0), (9, 0.3, 70, 0.0, 0, 0.0, 0, 0, 0, 1, 0, 0), (5, 1.0, 60, 0.0, 4, 1.0, 1, 1, 0, 1, 0, 0), (14, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0, 1, 0, 0),
    (2, 0.0, 5, 0.0, 20, 0.0, 1, 1, 0, 1, 1, 0), (20, 0.5, 30, 0.0, 3, 1.0, 0, 0, 0, 1, 0, 0), (12, 0.0, 90, 0.0, 45, 0.0, 1, 1, 0, 1, 0, 0), (7, 0.0, 8, 0.0, 9, 0.0, 0, 0, 0, 1, 0, 0),
    (40, 0.8, 30, 0.0, 20, 0.9, 1, 1, 0, 1, 0, 0), (60, 0.7, 5, 1.0, 50, 0.0, 0, 0, 0, 1, 0, 0), (16, 0.0, 70, 0.0, 60, 0.0, 1, 1, 0, 1, 0, 0), (18, 0.1, 40, 0.0, 30, 0.0, 0, 0, 0, 1, 0, 0),
])


def hinted(names: str) -> int:
    """What a class or id says of its element: 3 for readers' comments and pop-ups, 2 for another part that isn't the article's, 1 if that may be so, else 0."""
    most = 0
    for name in names.split():
        parts = [re.sub(r"\d+$", "", x).lower() for x in re.split("[-_]+|(?<=[a-z])(?=[A-Z])", name)]
        parts = [x for x in parts if x]
        if any(x in LAYOUT for x in parts):
            continue
        weak = any(x in WEAK for x in parts) and all(x in WEAK or x in PLACE for x in parts)
        most = max(most, 3 if any(x in READERS for x in parts) else 2 if any(x in STRONG for x in parts) else int(weak))
    return most


def tokens(page: str) -> Iterator[re.Match]:
    """The page's tags and comments in order; those inside of RAW elements are not looked at."""
    at = 0
    while m := TOKEN.search(page, at):
        yield m
        at = m.end()
        raw = RAW.get((m[2] or m[5] or "").lower())
        if raw and not (m[1] or m[4]) and not (m[3] or m[6] or "").rstrip().endswith("/"):
            end = raw.search(page, at)
            at = end.start() if end else len(page)


class _Part:
    """An element that may be a margin of the page: how strongly its tag (aside) and its name (hint) say so, and what stands around it."""

    __slots__ = ("aside", "hint", "margin", "around", "inside_main", "words", "seen")

    def __init__(self, aside: int, hint: int, margin: float, around: _Part | None, inside_main: _Part | None):
        self.aside, self.hint, self.margin, self.around, self.inside_main, self.words = aside, hint, margin, around, inside_main, 0
        self.seen: tuple[int, int] | None = None

    def own(self, total: int) -> tuple[int, int]:
        return (0, 0) if self.words >= LEAST_WORDS and self.words > self.margin * total else (self.aside, self.hint)


def _standing(part: _Part | None, total: int, up: str) -> tuple[int, int]:
    """aside and hint of a part and those around it, up to the next article if `up` says so."""
    aside = hint = 0
    while part:
        a, h = part.own(total)
        aside, hint, part = max(aside, a), max(hint, h), getattr(part, up)
    return aside, hint


def blocks(page: str) -> list[tuple[str, tuple]]:
    """The page's blocks in order: the text, and its FEATURES."""
    found: list[list] = []  # text, link density, words, main, part inside of the article, part around it, hidden or readers' part, heading
    open_: list[tuple] = []  # tag, then the state: main, part inside, part around, hidden, heading, link
    parts: list[_Part] = []
    text: list[str] = []
    linked = 0
    clear = state = (0, None, None, 0, 0, 0)
    skip = ""
    at = 0

    def flush() -> None:
        nonlocal linked
        words = entities.unescape("".join(text)).split()
        if words:
            n = min(len(words), linked)
            found.append([" ".join(words), n / len(words), len(words), *state[:5]])
            if not state[3] and (part := state[1] or state[2]):
                part.words += len(words) - n
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not skip:
            text.append(piece)
            if state[5]:
                linked += len(piece.split())

    for m in tokens(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing = m[1] or m[4]
        if not tag:
            if m[0].startswith("<![CDATA[") and not skip:
                add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if skip:
            if closing and tag == skip:
                skip = ""
            continue
        attributes = m[3] or m[6] or ""
        if tag == "br":
            text.append(" ")
            continue
        if not closing and tag in SKIPPED:
            if tag not in INLINE:
                flush() if tag == "title" else text.append(" ")
            if not attributes.rstrip().endswith("/"):
                skip = tag
            continue
        if tag not in INLINE:
            flush()
        if closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    del open_[k:]
                    break
        elif tag not in VOID:
            if tag in CLOSES_P or tag == "li":
                same = "li" if tag == "li" else "p"
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == same:
                        del open_[k:]
                        break
                    if open_[k][0] not in INLINE:
                        break
            main, inside, around, hidden, heading, link = open_[-1][1:] if open_ else clear
            hint, role, opens = 0, "", tag in MAIN
            if attributes and tag not in ("body", "html"):
                for a in ATTRIBUTE.finditer(attributes):
                    value = a[2] or a[3] or a[4] or ""
                    if a[1].lower() in ("class", "id"):
                        hint = max(hint, hinted(value))
                    elif a[1].lower() == "role":
                        role = value.lower()
                    opens |= role == "main" or value.lower() == "articlebody"
                hidden |= bool(HIDDEN.search(QUOTED.sub(" ", attributes)) or UNSEEN.search(attributes))
            hidden |= hint == 3
            if opens:
                main, around, inside = 1, inside or around, None
            else:
                aside = int(tag in ASIDE or tag in FORMS or bool(ROLE.search(role)))
                if tag == "header" and main:  # that of the article: its title stays, the rest may
                    aside, hint = 0, max(hint, 1)
                if re.fullmatch("h[1-6]", tag):
                    heading = 1
                elif tag == "a":
                    link = 1
                if aside or hint:
                    inside = _Part(aside, min(hint, 2), FORM_MARGIN if tag in FORMS else MARGIN, inside or around, inside)
                    parts.append(inside)
            open_.append((tag, main, inside, around, hidden, heading, link))
        state = open_[-1][1:] if open_ else clear
    add(page[at:])
    flush()
    return _described(found, parts)


def _described(found: list[list], parts: list[_Part]) -> list[tuple[str, tuple]]:
    plain = [round(n * (1 - density)) for _, density, n, *_ in found]
    for part in reversed(parts):  # inner parts come after those around them
        if part.around:
            part.around.words += part.words
    total = sum(p for p, b in zip(plain, found, strict=True) if not b[6])
    known: dict[tuple[int, str], tuple[int, int]] = {}

    def standing(part: _Part | None, up: str) -> tuple[int, int]:
        if part is None:
            return 0, 0
        if (key := (id(part), up)) not in known:
            known[key] = _standing(part, total, up)
        return known[key]

    near = [standing(b[4], "inside_main") for b in found]
    far = [standing(b[5], "around") for b in found]
    # Without an article that stands free, what stands around one is the layout of the page.
    free = any(b[3] and not b[6] and f == n == (0, 0) for b, f, n in zip(found, far, near, strict=True))
    places = []
    for b, f, n in zip(found, far, near, strict=True):
        aside, hint = (max(n[0], f[0]), max(n[1], f[1])) if free or not b[3] else n
        places.append((b[3], aside, 2 if b[6] else 0 if hint == 1 and b[7] and b[3] else hint))
    words = sum(p for p, (_, aside, hint) in zip(plain, places, strict=True) if not aside and hint < 2)
    in_main = sum(p for p, (main, aside, hint) in zip(plain, places, strict=True) if main and not aside and hint < 2)
    has_main = int(any(p[0] for p in places) and in_main >= LEAST_MAIN * words)
    out = []
    for i, (b, (main, aside, hint)) in enumerate(zip(found, places, strict=True)):
        before, after = (found[i - 1] if i else None), (found[i + 1] if i + 1 < len(found) else None)
        neighbour = lambda b: (b[2], b[1]) if b else (0, 0.0)
        out.append((b[0], (b[2], b[1], *neighbour(before), *neighbour(after), main * has_main, has_main, aside, hint, b[7])))
    return out


def grow(table: np.ndarray, least: int = 2, depth: int = 8):
    """A decision tree by Gini impurity: a label, or (feature, threshold, tree up to it, tree above)."""
    labels = table[:, -1]
    if depth == 0 or len(table) < 2 * least or labels.min() == labels.max():
        return int(labels.mean() >= 0.5)
    best = None
    for f in range(table.shape[1] - 1):
        values = np.unique(table[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = table[:, f] <= cut
            if low.sum() < least or (~low).sum() < least:
                continue
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (labels[low], labels[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut
    if best is None:
        return int(labels.mean() >= 0.5)
    _, f, cut = best
    low = table[:, f] <= cut
    return f, float(cut), grow(table[low], least, depth - 1), grow(table[~low], least, depth - 1)


def decide(tree, features: tuple) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if features[f] <= cut else high
    return tree


def main_text(page: str | None, tree) -> tuple[str, int]:
    """The main text of a page and the number of its blocks that were left out."""
    found = blocks(page or "")
    kept = [text for text, features in found if decide(tree, features)]
    return "\n\n".join(kept), len(found) - len(kept)


def _extractor(tree):
    def run(batches):
        for batch in batches:
            got = [main_text(page, tree) for page in batch.column("html").to_pylist()]
            text = pa.array([g[0] for g in got], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), text, pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())],
                ["page_id", "url", "text", "n_chars", "blocks_dropped"],
            )

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and blocks_dropped for every row of pages (page_id, url, html).

    A null or empty html has the empty text. Repeated rows get a row each; ids and urls may be null,
    and an empty table gives an empty result. Very long pages are read whole. Other columns, whatever
    their names, are not read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = bounded_batches(pages).select("page_id", "url", "html")
    return rows.mapInArrow(_extractor(grow(LABELLED)), f"page_id {kind}, url string, text string, n_chars long, blocks_dropped long")
