"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; no tree of nodes is built.  Every block's
text between two block tags is a *line* with the tags in it, the characters in links and
the element that holds it.  From there:

1. Lines in elements that are clutter by tag, role, or the words of class and id (menus,
   headers, footers, sidebars, notices, adverts, forms, reader comments) are out.
2. The ratio of characters to tags of the lines is smoothed by a Gaussian along the page,
   and a threshold between two clusters of its logarithm parts content from the rest.
3. Where the page names its article (``article``, ``main``, ``articleBody``) the region is
   that element; elsewhere it is the innermost element with most of the content's characters.
   Short lines of the region stay if they stand among content: in the same element, between
   two content lines, or in an element alike.  Lists of nothing but links are menus.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: Tags within a line; all others begin and end lines.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their text is never read.
UNSEEN = frozenset("script style noscript template svg title canvas iframe object audio video select option datalist textarea button map".split())
CLUTTER_TAGS = frozenset("nav footer aside form menu dialog".split())
CLUTTER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Elements in which an article may stand.
SECTIONS = frozenset("html body div section article main center table tbody tr td form span".split())
#: What an opening tag of each kind closes, up to the elements that hold such.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"})}
#: Words of class names and ids, at their beginning or end.
COMMENT_WORDS = frozenset("comment comments commentlist commentary commenters disqus respond reply replies discussion responses feedback reviews guestbook comentarios kommentare commentaires".split())
CLUTTER_WORDS = frozenset(
    "nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs crumbs pagination pager topbar toolbar masthead footer foot colophon copyright legal "
    "sidebar side sidenav rail aside widget widgets related recommended recommendations trending popular mostread teaser teasers share sharing sharebar social follow "
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot adunit sponsor sponsored sponsors promo promos promotion promoted banner outbrain taboola "
    "cookie cookies consent gdpr notice notices alert alerts notification notifications announcement modal popup overlay lightbox toast newsletter subscribe subscription "
    "signup login signin register search searchbox form paywall skip disclaimer hidden".split()
)
HEADER_WORDS = frozenset({"header", "masthead", "banner"})
#: Headings over reader comments.
COMMENT_HEADING = re.compile(r"(?i)^\W*(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)\b[\s\d():]*$|^(?:leave\s+a\s+(?:reply|comment))\b")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Lines on each side that smooth a line, and the shares of content that a part must hold to be the region.
SIGMA, REACH, MOST, HALF = 1.0, 2, 0.6, 0.5

SEEN, HEADER, CLUTTER, COMMENT, GONE = 0, 1, 2, 3, 4


def _named(value: str) -> int:
    """What the words of a class or an id say an element is."""
    worst = SEEN
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or {"with", "has", "no", "without"} & {*words}:
            continue
        for w in (words[0], words[-1], name.lower()):
            worst = max(worst, COMMENT if w in COMMENT_WORDS else HEADER if w in HEADER_WORDS else CLUTTER if w in CLUTTER_WORDS else SEEN)
    return worst


class PageLines(HTMLParser):
    """A page's lines, and of its elements the parent, tag, kind and looks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.kind, self.looks = [0], [""], [SEEN], [""]
        self.marked: list[int] = []  # elements that say they hold the article
        self.titles: list[int] = []
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, characters in links, element
        self.stack, self.open = [0], Counter()
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.unseen = self.anchor = 0
        self.kinds: dict[str, int] = {}

    def read(self, html: str) -> None:
        """All of a page.  What never ends, ends with the page, found without a search for each beginning."""
        self.last = html.rfind(">")
        self.feed(html)
        self.close()
        self.end_line()

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = self.rawdata.find("-->", i + 4)
        return end + 3 if end >= 0 else len(self.rawdata)

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if i <= self.last else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if i <= self.last else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        return super().parse_pi(i) if i <= self.last else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        if i > self.last and not self.rawdata.startswith("<!--", i):
            return len(self.rawdata)
        return super().parse_html_declaration(i)

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.stack[-1]))
                self.tags = 0
            self.parts.clear()
        self.linked = 0

    def pop(self) -> str:
        at = self.stack.pop()
        tag = self.tag[at]
        self.open[tag] -= 1
        self.unseen -= self.kind[at] == GONE
        return tag

    def close_until(self, tags: set[str], within: set[str]) -> None:
        """Close the outermost of ``tags`` that is open inside of ``within``."""
        if not any(self.open[t] for t in tags):
            return
        last = None
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[i]]
            if tag in within:
                break
            if tag in tags:
                last = i
        while last is not None and len(self.stack) > last:
            self.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        kind = SEEN
        named = marked = ""
        if tag in UNSEEN:
            kind = GONE
        elif tag in CLUTTER_TAGS:
            kind = CLUTTER
        elif tag == "header":
            kind = HEADER
        if attrs and kind < GONE:
            for key, value in attrs:
                if key in ("class", "id") and value:
                    named += " " + value
                elif key == "role" and value:
                    value = value.lower().strip()
                    kind = max(kind, HEADER if value == "banner" else CLUTTER if value in CLUTTER_ROLES else SEEN)
                    marked = marked or (value if value == "main" else "")
                elif key == "itemprop" and value and "articlebody" in value.lower():
                    marked = "main"
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
                    kind = GONE
            if named and tag not in ("html", "body", "main", "h1"):
                if named not in self.kinds:
                    self.kinds[named] = _named(named)
                own = self.kinds[named]
                kind = max(kind, own if tag not in ("article", *HEADINGS) or own != HEADER else SEEN)
        self.tags += 1
        if tag in VOID:
            if tag not in INLINE:
                self.end_line()
            elif tag == "br" and not self.unseen:
                self.parts.append(" ")
            return
        if tag in INLINE and kind == SEEN:
            self.anchor += tag == "a"
            return
        self.tags -= 1
        self.end_line()
        self.tags += 1
        if tag not in INLINE and self.open["p"]:
            self.close_until({"p"}, {"td", "th", "button", "article", "section", "div"})
        if tag in CLOSES:
            self.close_until(*CLOSES[tag])
        at = len(self.tag)
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.kind.append(kind)
        self.looks.append(tag + named)
        if marked or tag in ("article", "main"):
            self.marked.append(at)
        if tag == "h1":
            self.titles.append(at)
        self.stack.append(at)
        self.open[tag] += 1
        self.unseen += kind == GONE
        if tag in HEADINGS or tag not in INLINE:
            self.anchor = 0

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        if not self.open[tag]:
            if tag in INLINE:
                if tag == "a":
                    self.anchor = max(0, self.anchor - 1)
            else:
                self.end_line()
            return
        if tag in INLINE and self.tag[self.stack[-1]] != tag:
            return  # a tag within a line closes no block
        self.end_line()
        while self.pop() != tag:
            pass

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)
            if self.anchor:
                self.linked += len(data)


def smoothed(values: list[float]) -> list[float]:
    """A Gaussian over ``REACH`` neighbours on each side, of those that are there."""
    kernel = [math.exp(-((d / SIGMA) ** 2) / 2) for d in range(REACH + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - REACH), min(len(values), i + REACH + 1)
        w = [kernel[abs(i - j)] for j in range(low, high)]
        out.append(sum(a * b for a, b in zip(w, values[low:high], strict=True)) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """Where two clusters of numbers part; below all of them if they do not differ by much."""
    low, high = min(values), max(values)
    if high - low < 1:
        return low
    cut = (low + high) / 2
    for _ in range(20):
        above = [v for v in values if v >= cut]
        below = [v for v in values if v < cut]
        new = (sum(above) / len(above) + sum(below) / len(below)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def main_text(html: str) -> str:
    """The text of the blocks of a page's article, in their order."""
    page = PageLines()
    page.read(html)
    parent, tag, kind, count = page.parent, page.tag, page.kind, len(page.tag)
    last = list(range(1, count + 1))  # behind an element's last descendant: elements are numbered as they open
    for at in range(count - 1, 0, -1):
        last[parent[at]] = max(last[parent[at]], last[at])
    inside, section = [False] * count, list(range(count))
    low, high = min((x[3] for x in page.lines), default=0), max((x[3] for x in page.lines), default=0)
    holds = lambda ordered, at: (i := bisect_left(ordered, at)) < len(ordered) and ordered[i] < last[at]
    for at in range(1, count):
        up, own = parent[at], kind[at]
        inside[at] = inside[up] or tag[at] in ("article", "main")
        section[at] = at if tag[at] in SECTIONS else section[up]
        if tag[at] == "form" and own == CLUTTER and holds(page.marked, at) or own in (HEADER, CLUTTER) and at <= low and high < last[at] and holds(page.titles, at):
            own = SEEN  # around the whole page
        if own == HEADER and not inside[at]:
            own = CLUTTER
        kind[at] = max(own, kind[up])
    lines = [x for x in page.lines if kind[x[3]] == SEEN or kind[x[3]] == HEADER and tag[x[3]] in HEADINGS]
    lines = _without_comments(lines, parent, tag, last)
    if not lines:
        return ""
    ratios = [math.log1p(r) for r in smoothed([len(x[0]) / max(1, x[1]) for x in lines])]
    cut = threshold(ratios)
    content = [r >= cut for r in ratios]
    scope, named = _scope(page, lines, content, last)
    within = [scope <= x[3] < last[scope] for x in lines]
    menus = _menus(lines, tag)
    if named:
        return " ".join(x[0] for i, x in enumerate(lines) if within[i] and not menus[i])
    best = [i for i in range(len(lines)) if within[i] and content[i]]
    home = [section[x[3]] for x in lines]
    homes, alike = {home[i] for i in best}, {(page.looks[home[i]], tag[lines[i][3]]) for i in best}
    kept = [within[i] and not menus[i] and (content[i] or home[i] in homes or best[0] < i < best[-1] or (page.looks[home[i]], tag[x[3]]) in alike) for i, x in enumerate(lines)]
    first = kept.index(True) if True in kept else 0
    while first and tag[lines[first - 1][3]] in HEADINGS:  # the title may stand outside of the element
        first -= 1
        kept[first] = True
    return " ".join(x[0] for i, x in enumerate(lines) if kept[i])


def _masses(page: PageLines, lines: list, chosen: list[bool]) -> list[int]:
    mass = [0] * len(page.tag)
    for x, yes in zip(lines, chosen, strict=True):
        mass[x[3]] += len(x[0]) if yes else 0
    for at in range(len(mass) - 1, 0, -1):
        mass[page.parent[at]] += mass[at]
    return mass


def _scope(page: PageLines, lines: list, content: list[bool], last: list[int]) -> tuple[int, bool]:
    """The element of the region, and whether the page itself names it."""
    mass = _masses(page, lines, [True] * len(lines))
    marked = [m for m in page.marked if mass[m] and page.kind[m] == SEEN]
    if marked:
        best = max(marked, key=lambda m: (mass[m], m))
        for m in marked:  # numbered from outside to inside
            if best < m < last[best] and mass[m] >= HALF * mass[best]:
                best = m
        return best, True
    mass = _masses(page, lines, content)
    children: dict[int, list[int]] = {}
    for at in range(1, len(page.tag)):
        if mass[at]:
            children.setdefault(page.parent[at], []).append(at)
    at = 0
    while True:
        own = children.get(at, [])
        heavy = max(own, key=lambda c: mass[c], default=None)
        if heavy is None or page.tag[heavy] not in SECTIONS or mass[heavy] < MOST * mass[at] or any(c != heavy and page.looks[c] == page.looks[heavy] for c in own):
            return at, False
        at = heavy


def _menus(lines: list, tag: list[str]) -> list[bool]:
    """Lines of lists that hold nothing but links, two or more in a row."""
    bare = [tag[x[3]] in ("li", "ul", "ol", "dd", "dt") and x[2] >= 0.9 * len(x[0]) for x in lines]
    return [b and (i > 0 and bare[i - 1] or i + 1 < len(bare) and bare[i + 1]) for i, b in enumerate(bare)]


def _without_comments(lines: list, parent: list[int], tag: list[str], last: list[int]) -> list:
    """Lines but those that follow a heading over reader comments in its element."""
    low, high, out = 0, 0, []  # the elements of the last one that such a heading is in
    for x in lines:
        if low <= x[3] < high:
            continue
        if tag[x[3]] in HEADINGS and COMMENT_HEADING.match(x[0]):
            low, high = parent[x[3]], last[parent[x[3]]]
        else:
            out.append(x)
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) if x.is_valid else "" for x in batch.column("html")]
        cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every row of ``pages``, read whole.

    Blocks are joined by one blank, white space within a block is one blank, character
    references are decoded.  Null and empty pages, and pages without content, give an
    empty text of no characters; null ids and urls stay; repeated rows give repeated
    rows; other columns are not read; an empty table gives no rows.  Unclosed elements
    end where the elements around them do.  Nothing is shuffled.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
