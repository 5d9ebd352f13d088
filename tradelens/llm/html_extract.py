"""Main text of HTML pages by line-block distribution (operator 7).

1. Strip markup: a linear scan turns the page into lines (one per block
   element).  Scripts, styles, comments and other raw elements go; elements
   that by tag, role, class or id are menus, headers, footers, sidebars,
   notices, adverts, forms or reader comments become empty lines.  A class or
   id counts by its whole tokens or their last part ("site-header"), not where
   it says what the element has or lacks ("has-sidebar", "comments-open"), and
   not alone: an element so named that holds most of the page's text is a
   layout wrapper and stays, and inside an article a name (adverts and
   comments apart) needs links, form fields or a short text to bear it out; a
   section or heading there needs links or fields.  Articles are comments
   inside a comment list, or when so named after the page's first article.
2. Weigh the lines: a line weighs its text length, links not counted; mostly
   linked lines weigh nothing, but in article or main elements they do so only
   in runs of ``WINDOW`` or more (a menu; a linked headline or source is text),
   and top headings always weigh.
   Where a page marks article or main elements and no container outside them
   holds more unlinked text (and ``SURGE`` of it), the lines outside weigh
   nothing; otherwise those marked lines weigh nothing that lie outside the
   heaviest container.
3. Line-block distribution, on every page: weights are summed over sliding
   windows of ``WINDOW`` lines.  A stretch begins where the sum rises from
   zero and ends where it dives back to zero; it is text if its sum surges
   above ``SURGE`` somewhere.  If no stretch surges the heaviest one is the
   text.  A dropped element breaks a stretch (``WINDOW`` empty lines) only
   between containers, and the other stretches of a chosen container (the
   page itself is none) or marked element are chosen with it.
4. All lines between the rise and the dive, or between the first and the last
   stretch of a chosen container, are kept, short and linked ones included.

Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by an empty line.

Defined results: null or empty html gives an empty text, and so does a page
without any text outside the stripped parts; an element never closed ends
with the one around it or with the page, paragraphs, list items, terms, rows
and cells where HTML lets the next one end them, and a menu, header or advert
never swallows an article that starts inside it; repeated rows give repeated results; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import named

WINDOW = 3
SURGE = 80

# Fixed HTML vocabulary.
RAW_TAGS = frozenset("script style noscript textarea title iframe head".split())
MEDIA_TAGS = frozenset("svg object canvas video audio template".split())  # what is inside stands in for the media
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACE_TAGS = frozenset("br td th option wbr".split())
DROP_TAGS = frozenset("nav footer aside form button select menu dialog fieldset label input".split())
TABLE_TAGS = frozenset("caption table tbody td tfoot th thead tr".split())
# Elements whose end tag is optional: what a new element closes, and what such a search does not go beyond.
P_TAGS = frozenset(("p",))
P_SCOPE = frozenset("button td th caption table article main".split())
LIST_SCOPE = frozenset("ul ol menu dl table td th caption section article aside main nav header footer blockquote form figure fieldset details".split())
TABLE_SCOPE = frozenset(("table",))
IMPLIED = {
    "li": (frozenset(("li",)), LIST_SCOPE),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), LIST_SCOPE)),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), TABLE_SCOPE)),
    "tr": (frozenset(("tr",)), TABLE_SCOPE),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset(("thead", "tbody", "tfoot", "caption")), TABLE_SCOPE)),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
NO_P_CLOSE = frozenset("caption tbody tfoot thead tr legend".split())  # blocks that stand in no paragraph
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FIELD_TAGS = frozenset("input select textarea button".split())
BOX_TAGS = frozenset("div article main td th center details".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay share sharing social "
    "related recommended recommendations footer header masthead toolbar pagination pager widget widgets login signup search form copyright".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies reply".split())
# Parts of a class or id that say no more than what stands before them ("ad-box", "related-posts"); after adverts and comments also those of OWN_PARTS.
PART_NAMES = frozenset("area articles bar block blocks bottom box button buttons column container group icons inner item items left link links list panel posts right row section slot stories top unit x".split())
OWN_PARTS = frozenset("author body content entry header image label meta module node text thread title".split())
AD_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored promo promotion".split()) | COMMENT_NAMES
# A class that speaks of something the element has, lacks or does with it ("has-sidebar").
QUALIFIERS = frozenset("has have no not with without hide show toggle is".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""")
_RAW_END = {tag: re.compile(rf"</{tag}(?![a-z0-9-])[^>]*>?", re.A | re.I) for tag in RAW_TAGS}
_ATTR = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = re.compile(r"[a-z]+|\d+")


@lru_cache(maxsize=1 << 14)
def _named(token: str) -> str:
    """The name in DROP_NAMES or COMMENT_NAMES that a class or id token is or
    ends with, trailing part names and numbers aside; "" if there is none."""
    # camelCase, snake_case and kebab-case names in parts
    parts = _NAMES.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
    own = not AD_NAMES.isdisjoint(parts)
    while len(parts) > 1 and parts[-1] not in DROP_NAMES - OWN_PARTS and (parts[-1].isdigit() or parts[-1] in PART_NAMES or (own and parts[-1] in OWN_PARTS)):
        parts.pop()
    if not parts or not QUALIFIERS.isdisjoint(parts[:-1]):
        return ""
    return parts[-1] if parts[-1] in DROP_NAMES or parts[-1] in COMMENT_NAMES else ""


def _dropped(tag: str, attrs: str, in_main: bool, seen_main: bool) -> str:
    """Why an element is not part of the text: "comment", "chrome", "name"
    (chrome by nothing but its class or id), "part" (so named inside an
    article) or ""."""
    if tag in MEDIA_TAGS:
        return "chrome"
    if tag in ("html", "body", "main"):
        return ""
    kind, role, hidden = set(), "", False
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            kind.update(_named(token) for token in value.split())
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
    if tag == "article":  # the first article of a page is no comment; those in a comment list go with the list
        return "comment" if kind & COMMENT_NAMES and seen_main else ""
    if kind & COMMENT_NAMES:
        return "comment"
    if tag in DROP_TAGS or (tag == "header" and not in_main) or role in DROP_ROLES or hidden:
        return "chrome"
    if not in_main:
        return "name" if kind & DROP_NAMES else ""
    return "name" if kind & AD_NAMES else "part" if kind & (DROP_NAMES - {"header"}) else ""


class _Page:
    """A page as a flat list of events with properly nested elements.

    Events are texts (text, linked), breaks (``None`` for a block, "" for a
    space) and element numbers: ``e`` opens element e, ``~e`` closes it.
    Element 0 is the page."""

    def __init__(self, html: str):
        self.events: list = []
        self.tag, self.why, self.parent = [""], [""], [0]
        self.own, self.solid = [0], [0]  # unlinked characters; paragraphs, a top heading counting twice
        self.linked, self.fields = [0], [0]  # linked characters; form fields
        self.end = [0]  # event that closes the element
        self.open, self.n_open = [0], Counter()
        self.next_end: dict[str, int] = {}  # of a media element: the next closing tag, or the page's end
        self.main_depth, self.seen_main = 0, False
        self._read(html)
        while len(self.open) > 1:
            self._pop()
        self.last = list(range(len(self.tag)))  # the last element inside each one
        for e in range(len(self.tag) - 1, 0, -1):
            self.last[self.parent[e]] = max(self.last[self.parent[e]], self.last[e])
        self._exempt()

    def within(self, e: int, outer: int) -> bool:
        return outer <= e <= self.last[outer]

    def _push(self, tag: str, why: str) -> None:
        e = len(self.tag)
        self.tag.append(tag)
        self.why.append(why)
        self.parent.append(self.open[-1])
        self.own.append(0)
        self.solid.append(0)
        self.linked.append(0)
        self.fields.append(0)
        self.end.append(0)
        self.open.append(e)
        self.n_open[tag] += 1
        self.events.append(e)
        if tag in MAIN_TAGS and not why:
            self.main_depth += 1
            self.seen_main = True

    def _pop(self) -> None:
        e = self.open.pop()
        self.end[e] = len(self.events)
        self.events.append(~e)
        tag, up = self.tag[e], self.parent[e]
        self.n_open[tag] -= 1
        if tag in MAIN_TAGS and not self.why[e]:
            self.main_depth -= 1
        self.linked[up] += self.linked[e]
        self.fields[up] += self.fields[e]
        if not self.why[e]:
            self.own[up] += self.own[e]
            self.solid[up] += self.solid[e] + (2 if tag == "h1" else tag == "p" and self.own[e] > 0)

    def _pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self._pop()

    def _close(self, tag: str) -> None:
        """A closing tag ends its element and all that is open inside; one
        that fits no open element, or only one around the article or the table cell, is ignored."""
        block = False
        for at in range(len(self.open) - 1, 0, -1) if self.n_open[tag] else ():
            e = self.open[at]
            here = self.tag[e]
            if here == tag:
                if tag in BLOCK_TAGS or tag in SPACE_TAGS or not block or self.why[e]:
                    self._pop_to(at)
                return
            if here in MAIN_TAGS and tag not in MAIN_TAGS and not self.why[e]:
                return
            if here in ("td", "th", "caption") and tag not in TABLE_TAGS and tag not in MAIN_TAGS:
                return
            block = block or here in BLOCK_TAGS

    def _imply(self, closes: frozenset, scope: frozenset) -> None:
        """Close the innermost open element of ``closes`` within ``scope``."""
        for at in range(len(self.open) - 1, 0, -1) if any(self.n_open[t] for t in closes) else ():
            here = self.tag[self.open[at]]
            if here in closes:
                self._pop_to(at)
                return
            if here in scope:
                return

    def _opened(self, tag: str, attrs: str) -> None:
        why = _dropped(tag, attrs, self.main_depth > 0, self.seen_main)
        if tag in MAIN_TAGS and not why:
            # a menu, header or advert never swallows an article
            for at in range(1, len(self.open)):
                if self.why[self.open[at]] == "comment":
                    break
                if self.why[self.open[at]]:
                    self._pop_to(at)
                    break
            else:
                at = 0
            if at and at < len(self.open) and self.why[self.open[at]] == "comment":
                why = "comment"
        self._push(tag, why)

    def _read(self, html: str) -> None:
        link_depth = 0
        pos, n = 0, len(html)
        while pos < n:
            at = html.find("<", pos)
            if at < 0:
                at = n
            if at > pos:
                text = unescape(html[pos:at])
                self.events.append((text, link_depth > 0))
                (self.linked if link_depth else self.own)[self.open[-1]] += len(text.strip())
            if at == n:
                break
            if html.startswith("<!--", at):
                stop = html.find("-->", at + 4)
                pos = n if stop < 0 else stop + 3
                continue
            nxt = html[at + 1 : at + 2]
            if nxt in ("!", "?"):
                stop = html.find(">", at)
                pos = n if stop < 0 else stop + 1
                continue
            m = _TAG.match(html, at)
            if m is None:
                if not (nxt.isalpha() or nxt == "/"):  # a bare "<" is text
                    self.events.append(("<", False))
                    pos = at + 1
                else:  # broken or cut tag
                    stop = html.find(">", at)
                    pos = n if stop < 0 else stop + 1
                continue
            closing, tag, attrs = m[1] == "/", m[2].lower(), m[3]
            pos = m.end()
            whole = not closing and attrs.endswith("/") and attrs[-2:-1] in ("", " ", "\t", "\n", "\r", "\f", '"', "'")  # <x/>; a bare value may end in "/"
            if not closing and tag in FIELD_TAGS:
                self.fields[self.open[-1]] += 1
            if not closing and tag in RAW_TAGS and not whole:
                close = _RAW_END[tag].search(html, pos)
                if close:
                    pos = close.end()
                elif tag != "head":  # a head without an end: the body follows anyway
                    pos = n
                continue
            if tag == "a":
                link_depth = max(0, link_depth + (-1 if closing else 1))
            elif tag in BLOCK_TAGS:
                link_depth = 0
            if tag in BLOCK_TAGS:
                self.events.append(None)
            elif tag in SPACE_TAGS:
                self.events.append("")
            if not closing and tag in BLOCK_TAGS and tag not in NO_P_CLOSE:
                self._imply(P_TAGS, P_SCOPE)
            if not closing and tag in IMPLIED:
                self._imply(*IMPLIED[tag])
            if tag in VOID_TAGS or tag in ("html", "body") or whole:
                continue
            if not closing and tag in MEDIA_TAGS and not self._ends(tag, html, pos):
                continue
            if closing:
                self._close(tag)
            else:
                self._opened(tag, attrs)

    def _ends(self, tag: str, html: str, pos: int) -> bool:
        """Whether a media element is closed at all; one that is not holds nothing."""
        if self.next_end.get(tag, -1) < pos:
            found = re.compile(f"</{tag}(?![a-z0-9-])", re.A | re.I).search(html, pos)
            self.next_end[tag] = found.start() if found else len(html)
        return self.next_end[tag] < len(html)

    def _exempt(self) -> None:
        """Elements dropped for nothing but their class or id: inside an
        article they stay without something else that speaks for it, and one
        that holds most of the page's unlinked text, in paragraphs, is a
        layout wrapper."""
        for e in range(len(self.tag) - 1, 0, -1):
            if self.why[e] == "part":
                listed = self.fields[e] or 2 * self.linked[e] >= self.linked[e] + self.own[e]
                if not listed and (self.tag[e] in HEADINGS or self.tag[e] == "section" or self.own[e] >= SURGE):
                    self.why[e] = ""
                    self.own[self.parent[e]] += self.own[e]
                    self.solid[self.parent[e]] += self.solid[e]
                else:
                    self.why[e] = "name"
        named = [e for e in range(len(self.tag)) if self.why[e] == "name"]
        total = self.own[0] + sum(self.own[e] for e in named)
        for e in reversed(named):
            if 2 * self.own[e] > total and self.solid[e] >= 2:
                self.why[e] = ""
                up = self.parent[e]
                while up:
                    self.own[up] += self.own[e]
                    self.solid[up] += self.solid[e]
                    if self.why[up]:
                        break
                    up = self.parent[up]


class _Line(NamedTuple):
    text: str
    linked: int  # linked characters
    marked: int  # the article or main element around it, 0 if none
    title: bool  # a top heading
    box: int  # innermost container: an element with blocks of its own, not a list, section or quotation


def _lines(page: _Page) -> list[_Line]:
    """Lines in page order; dropped elements between containers as empty lines."""
    boxes = {page.parent[e] for e in range(1, len(page.tag)) if page.tag[e] in BLOCK_TAGS and not page.why[e]}
    lines: list[_Line] = []
    buf: list[str] = []
    linked = 0
    box, outer = 0, []
    marks = [0]
    title = 0
    gaps: list[tuple[int, int]] = []  # line and container of a dropped element

    def end_line() -> None:
        nonlocal linked
        text = " ".join("".join(buf).split())
        if text:
            lines.append(_Line(text, linked, marks[-1], title > 0, box))
        buf.clear()
        linked = 0

    at, n = 0, len(page.events)
    while at < n:
        x = page.events[at]
        at += 1
        if x is None:
            end_line()
        elif x == "":
            buf.append(" ")
        elif isinstance(x, tuple):
            buf.append(x[0])
            if x[1]:
                linked += len(x[0])
        else:
            e = x if x >= 0 else ~x
            tag = page.tag[e]
            if tag in BLOCK_TAGS:
                end_line()
            if x >= 0 and page.why[e]:
                at = page.end[e] + 1
                gaps.append((len(lines), box))
                continue
            if tag == "h1":
                title += 1 if x >= 0 else -1
            if tag in MAIN_TAGS:
                if x >= 0:
                    marks.append(marks[-1] or e)
                else:
                    marks.pop()
            if tag in BOX_TAGS and e in boxes:
                if x >= 0:
                    outer.append(box)
                    box = e
                else:
                    box = outer.pop()
    end_line()
    out, done = [], 0
    for k, c in gaps:
        out.extend(lines[done:k])
        done = k
        # inside one container when both neighbours are in it and one of them not in a container within
        near = [x.box for x in lines[max(0, k - 1) : k + 1]]
        joined = c in near and all(page.within(x, c) if c else x == c for x in near)
        if not joined:
            out.extend([_Line("", 0, 0, False, c)] * WINDOW)
    return out + lines[done:]


def _weights(page: _Page, lines: list[_Line]) -> list[int]:
    """What each line counts for in the distribution (step 2)."""
    plain = [len(x.text) if 2 * x.linked <= len(x.text) else 0 for x in lines]
    marked = [bool(x.marked) for x in lines]
    weight = list(plain)
    if not any(marked):
        return weight
    i = 0
    while i < len(lines):  # linked lines of a marked element, in runs
        j = i
        while j < len(lines) and marked[j] and lines[j].text and not plain[j] and not lines[j].title:
            j += 1
        if 0 < j - i < WINDOW:
            weight[i:j] = [len(x.text) for x in lines[i:j]]
        elif i == j and marked[i] and lines[i].title:
            weight[i] = len(lines[i].text)
        i = max(j, i + 1)
    heavy: Counter = Counter()
    for x, w in zip(lines, plain, strict=True):
        if not x.marked:
            heavy[x.box] += w
    most = max(heavy, key=heavy.__getitem__, default=0)
    if sum(w for w, m in zip(plain, marked, strict=True) if m) >= heavy[most] or heavy[most] < SURGE:
        return [w if m else 0 for w, m in zip(weight, marked, strict=True)]
    return [0 if m and not page.within(x.box, most) else w for x, w, m in zip(lines, weight, marked, strict=True)]


def window_sums(weight: list[int]) -> list[int]:
    """Sum of the ``WINDOW`` weights from each line on."""
    total, out = 0, [0] * len(weight)
    for i in range(len(weight) - 1, -1, -1):
        total += weight[i] - (weight[i + WINDOW] if i + WINDOW < len(weight) else 0)
        out[i] = total
    return out


def stretches(weight: list[int]) -> list[tuple[int, int, int, int]]:
    """The distribution's stretches: (surge, weight, first, last weighted line)."""
    sums, found, i = window_sums(weight), [], 0
    while i < len(weight):
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < len(weight) and sums[j]:
            j += 1
        # window i reaches WINDOW - 1 lines ahead: the rise is at its first weighted line, the dive at the last
        own = [x for x in range(i, min(j + WINDOW - 1, len(weight))) if weight[x]]
        found.append((max(sums[i:j]), sum(weight[x] for x in own), own[0], own[-1]))
        i = j
    return found


def main_text(html: str | None) -> str:
    """Main text of one page."""
    page = _Page(html or "")
    lines = _lines(page)
    weight = _weights(page, lines)
    found = stretches(weight)
    chosen = [s for s in found if s[0] >= SURGE] or sorted(found, key=lambda s: -s[1])[:1]
    spans = [(first, last) for *_, first, last in chosen]
    hit = [x for first, last in spans for x in range(first, last + 1) if weight[x]]
    for of in (lambda x: x.box, lambda x: x.marked):  # first and last weighted line of each chosen container and marked element
        ends: dict[int, tuple[int, int]] = {}
        taken = {of(lines[x]) for x in hit} - {0}
        for x, line in enumerate(lines):
            if weight[x] and of(line) in taken:
                ends[of(line)] = (ends.get(of(line), (x, x))[0], x)
        spans += ends.values()
    # an element's lines lie together, so a container's span holds nothing else
    depth, steps = 0, [0] * (len(lines) + 1)
    for first, last in spans:
        steps[first] += 1
        steps[last + 1] -= 1
    kept = []
    for x, line in enumerate(lines):
        depth += steps[x]
        if depth and line.text:
            kept.append(line.text)
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` (main text) and ``n_chars`` of every page."""
    rows = pages.select(*[named(c) for c in keep], named(html_col).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column(len(keep))], type=pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], texts], [*keep, "_text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    made = rows.mapInArrow(run, f"{schema}, _text string")
    return made.select(*[named(c) for c in keep], F.col("_text").alias("text"), F.char_length("_text").cast("long").alias("n_chars"))
