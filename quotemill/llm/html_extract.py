"""HTML extraction 4: two-pass block rules.

A page is cut into blocks at block-level tags. Pass 1 decides blocks alone: what stands in menus, headers, footers, sidebars,
notices, adverts, forms or comments (by element, role, class or id) or is mostly links is bad; long blocks dense in stop words are good; those
without stop words that hold links are bad; the others, short or in between, are ambiguous. Pass 2 gives ambiguous blocks the label of the nearest decided
neighbours: that of both where they agree, else good if the block is close to good, or stands nearer to a good one.

Both passes run on every page. If the page marks its article (article, main, or the like), that is evidence: inside, blocks that are close
to good are good, links and lack of stop words make a block ambiguous rather than bad unless nearly all is links, and the mark's edge counts as a good neighbour; outside, long blocks dense
in stop words are still good, but ambiguous ones only between good ones.

Good blocks are joined in page order by a newline; character references are decoded, white space within a block becomes one space.

Edge cases: null and empty pages give an empty text; so do pages without a good block. Markup that is cut off or not closed is read as far as it goes. Very long
pages are worked on whole, in time that follows their length, however broken. Repeated rows and tied ids stay as they are. Further columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "a an and are as at be been but by for from had has have he her his i in is it its my not of on or our she so that the their them there they this to was we were what when which who will with you your",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder sich sie sind so um und uns vom von vor war was wie wir zu zum zur über",
    "fr": "a au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes mon ne nos nous on ou où par pas pour qu que qui sa se ses son sur ta te tu un une vos votre vous à été",
    "es": "a al algo como con cuando de del desde donde el ella ellos en entre era es esta este esto fue ha hay la las le lo los me mi muy más ni no nos o para pero por que qué se ser si sin sobre son su sus también te tu un una y ya yo él",
}
#: Characters of short and of long blocks; stop-word densities of near-good and good ones; share of text in links of bad ones.
SHORT, LONG, STOP_LOW, STOP_HIGH, MOST_LINKS = 70, 200, 0.2, 0.3, 0.5

BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html li main menu nav ol search section table td th tr ul".split())
BAD_ELEMENTS = frozenset("nav footer aside form menu dialog search fieldset legend label input".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BAD_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox banner promo promotion sponsor sponsored sponsors sidebar side sidenav rail menu menus nav navbar navigation topnav subnav footer foot masthead topbar bottombar breadcrumb breadcrumbs crumbs cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay comment comments commentlist reply replies respond discussion disqus share sharing sharebar social follow related recommended recommendations teaser teasers newsletter subscribe subscription signup signin login register search widget widgets pagination pager paging copyright legal disclaimer toolbar skip paywall outbrain taboola tags taglist".split())
HEADER_NAMES = frozenset("header head".split())
MAIN_NAMES = frozenset("articlebody articlecontent articletext postbody postcontent entrycontent storybody maincontent bodycontent article post entry story content main".split())

#: Elements whose content is not markup, up to their end tag or the page's end; others whose content is no part of a text, if they are closed.
RAW_ELEMENTS = frozenset("script style title textarea iframe noframes".split())
DROPPED_ELEMENTS = frozenset("noscript template svg math select button object audio video canvas".split())

_MARK = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|!--|!\[CDATA\[|[!?/])")
_STOP, _ANGLE = re.compile("[>\"']"), re.compile("[<>]")
_CLOSERS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_ELEMENTS | DROPPED_ELEMENTS}
#: Numbers of character references that are too long for a code point, and zeros before one.
_HUGE, _ZEROS = re.compile(r"&#(?:[1-9][0-9]{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{6,});?"), re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}
_LETTERS = re.compile(r"[^\W\d_]+")

BAD, GOOD, NEAR, BRIEF = range(4)


@dataclass
class Block:
    text: str
    links: int  # characters in links
    barred: bool  # in a menu, footer, advert, ...
    inside: int  # 2: in an article or main element, 1: in something named like one, 0: in neither
    heading: bool


def _names(attrs: str) -> tuple[set[str], set[str], set[str]]:
    """The words of class and id, whole names without separators, and roles."""
    words: set[str] = set()
    whole: set[str] = set()
    roles: set[str] = set()
    for key, value in _NAMED.findall(attrs):
        for name in value.strip("\"'").split():
            if key.lower() == "role":
                roles.add(name.lower())
            else:
                whole.add(re.sub(r"[^a-z]", "", name.lower()))
                words |= {x.lower() for x in _PARTS.findall(name)}
    return words, whole, roles


def _region(tag: str, attrs: str, barred: bool, inside: int) -> tuple[bool, int]:
    """What an opened element makes of its content."""
    words, whole, roles = _names(attrs) if "=" in attrs else (set(), set(), set())
    if tag in BAD_ELEMENTS or roles & BAD_ROLES or (tag == "header" and not inside):
        barred = True
    if tag not in ("html", "body") and (words & BAD_NAMES or (words & HEADER_NAMES and not inside)):
        barred = barred or not (tag in ("article", "main") and not words & {"comment", "comments", "teaser", "related", "ad", "advert", "promo", "sponsored", "reply"})
    if tag in ("article", "main") or "main" in roles or whole & {"articlebody"}:
        inside = 2
    elif tag in ("div", "section", "td") and whole & MAIN_NAMES:
        inside = max(inside, 1)
    return barred, inside


class Tags:
    """Where tags end. Quoted values may hold any sign; each part of the page is searched a bounded number of times, whatever stands in it."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.stop = -1  # the next > or quote, from the last tag on
        self.after: dict[int, int] = {}  # opening quote: the end of the tag that it is in, or -1

    def _next(self, at: int) -> int:
        m = _STOP.search(self.page, at)
        return m.start() if m else len(self.page)

    def end(self, at: int) -> int:
        """The end of the tag whose name ends at ``at``, or -1; ``at`` must not go back."""
        page, passed, out = self.page, [], -1
        if self.stop < at:
            self.stop = self._next(at)
        p = self.stop
        while p < len(page):
            if page[p] == ">":
                out = p + 1
                break
            if p in self.after:
                out = self.after[p]
                break
            passed.append(p)
            q = page.find(page[p], p + 1)
            if q < 0:
                break
            p = self._next(q + 1)
        for p in passed:
            self.after[p] = out
        if out < 0 and (m := _ANGLE.search(page, at)) and m.group() == ">":  # a quote is never closed
            out = m.end()
        return out


def pieces_of(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text, closing, tag, attributes) in page order: a text, or a tag with an empty text. Comments, scripts and the like are left out."""
    tags, at, unclosed = Tags(page), 0, set()
    search = _MARK.search
    start = 0  # of the text that has not been given out
    while m := search(page, at):
        tag, end = (m[2] or "").lower(), -1
        if tag:
            end = tags.end(m.end())
            if end < 0 and not m[1] and _ANGLE.search(page, m.end()):  # no tag, but a sign
                at = m.end()
                continue
        elif m.group() in ("<!--", "<![CDATA["):
            close = "-->" if m.group() == "<!--" else "]]>"
            end = page.find(close, m.end()) + len(close)
            end = -1 if end < len(close) else end
        if end < 0:  # cut off, or a declaration
            end = page.find(">", m.end()) + 1 if not tag and m.group() not in ("<!--", "<![CDATA[") or m[1] else 0
            end = end or len(page)
        if m.start() > start:
            yield page[start : m.start()], False, "", ""
        attrs = page[m.end() : end - 1]
        if tag and not m[1] and tag in _CLOSERS:
            close = None if tag in unclosed or (tag in DROPPED_ELEMENTS and attrs.endswith("/")) else _CLOSERS[tag].search(page, end)
            if close:
                end = close.end()
            elif tag in RAW_ELEMENTS:
                end = len(page)
            else:
                unclosed.add(tag)
        elif tag:
            yield "", bool(m[1]), tag, attrs
        at = start = end
    if start < len(page):
        yield page[start:], False, "", ""


def decoded(text: str) -> str:
    """Character references decoded."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _HUGE.sub("�", _ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


class Opened:
    """The containers that are open, with what stood before each. Closing one takes time for those that it closes only."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int]] = []
        self.at: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, barred: bool, inside: int) -> None:
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, barred, inside))

    def last(self, *tags: str) -> int:
        """The innermost of these, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, k: int) -> tuple[bool, int]:
        """Closes the container k and all in it: (barred, inside) as before it."""
        _, barred, inside = self.stack[k]
        while len(self.stack) > k:
            self.at[self.stack.pop()[0]].pop()
        return barred, inside


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text."""
    out: list[Block] = []
    opened = Opened()
    barred, inside = False, 0
    own = heading = link = False  # the leaf block's own state
    text: list[str] = []
    links = 0

    def close() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(joined, min(links, len(joined)), barred or own, inside, heading))
        text.clear()
        links = 0

    for piece, closing, tag, attrs in pieces_of(page):
        if not tag:
            text.append(decoded(piece))
            if link:
                links += len(" ".join(text[-1].split()))
            continue
        if tag == "br" or tag == "hr":
            text.append(" ")
        if tag == "a":
            link = not closing
        if tag not in BLOCKS:
            continue
        close()
        own = heading = link = False
        if tag in CONTAINERS:
            if closing:
                if (k := opened.last(tag)) >= 0:
                    barred, inside = opened.close(k)
            elif not attrs.rstrip().endswith("/"):
                if tag == "li" and (k := opened.last("li")) > opened.last("ul", "ol", "menu"):  # may be left open
                    barred, inside = opened.close(k)
                opened.push(tag, barred, inside)
                barred, inside = _region(tag, attrs, barred, inside)
        elif not closing:
            own = "=" in attrs and _region(tag, attrs, False, inside)[0]
            heading = tag[0] == "h" and tag[1:].isdigit()
    close()
    return out


def stop_density(text: str) -> float:
    """The share of stop words among the words, in the language that has most."""
    words = _LETTERS.findall(text.lower())
    return max(sum(w in stops for w in words) for stops in _STOPS.values()) / len(words) if words else 0.0


def _standing(b: Block, least: int) -> int:
    """1: in what the page marks as its article; -1: on such a page, but in nothing of the kind; 0: neither."""
    return 0 if not least else 1 if b.inside == least else -1 if not b.inside else 0


def _alone(b: Block, standing: int) -> int:
    """Pass 1."""
    if b.barred:
        return BAD
    density = b.links / len(b.text)
    if density > MOST_LINKS:
        return BRIEF if standing > 0 and density <= 0.8 else BAD
    if len(b.text) < SHORT:
        return BAD if density > 0.2 and standing <= 0 else BRIEF
    stops = stop_density(b.text)
    if stops >= STOP_HIGH:
        return GOOD if len(b.text) > LONG or standing > 0 else NEAR
    if stops >= STOP_LOW:
        return GOOD if standing > 0 else NEAR
    if b.links:
        return BRIEF if standing > 0 else BAD
    return NEAR if len(b.text) > LONG else BRIEF


def passes(blocks: list[Block]) -> list[str]:
    """What decides each block: ``place`` (it is barred by where it stands), ``alone`` (pass 1) or ``neighbours`` (pass 2)."""
    least = max((b.inside for b in blocks if not b.barred), default=0)
    return ["place" if b.barred else "neighbours" if _alone(b, _standing(b, least)) in (NEAR, BRIEF) else "alone" for b in blocks]


def classify(blocks: list[Block]) -> list[bool]:
    """Which blocks belong to the article."""
    least = max((b.inside for b in blocks if not b.barred), default=0)
    stands = [_standing(b, least) for b in blocks]
    first = [_alone(b, s) for b, s in zip(blocks, stands, strict=True)]
    # What is barred by its place says nothing about its neighbours, nor does what is bad outside the marked article about what is inside.
    decided = [(i, x) for i, x in enumerate(first) if x in (GOOD, BAD) and not blocks[i].barred]
    marked = [(i, x) for i, x in decided if stands[i] > 0 or x == GOOD]
    out = []
    for i, label in enumerate(first):
        if label in (NEAR, BRIEF):
            known = marked if stands[i] > 0 else decided
            k = bisect_left(known, (i, 0))
            x, dx = (known[k - 1][1], i - known[k - 1][0]) if k else (None, 0)
            y, dy = (known[k][1], known[k][0] - i) if k < len(known) else (None, 0)
            if stands[i] < 0:  # outside the mark, only what good blocks enclose
                label = GOOD if x == y == GOOD else BAD
            elif x is None and y is None:
                label = GOOD
            elif x is None or y is None or x == y:
                label = x if x is not None else y
                # The edge of the marked article is a good neighbour, except to a heading of what is bad.
                if stands[i] > 0 and label == BAD and (x is None or y is None) and not (blocks[i].heading and y == BAD):
                    label = GOOD
            elif label == NEAR:
                label = GOOD
            elif blocks[i].heading:  # a heading goes with what follows
                label = y
            else:
                label = x if dx < dy else y if dy < dx else GOOD
        out.append(label == GOOD)
    return out


def extract(page: str | None) -> str:
    """The article's text."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, good in zip(blocks, classify(blocks), strict=True) if good)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. No shuffle."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "html"):
            text = [extract(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
