"""Main text of web pages from parser events, text-to-tag ratios and a smoothed threshold."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from itertools import groupby
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never content.
SKIPPED = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video button select textarea "
    "input label form fieldset nav footer aside menu dialog".split()
)
#: Elements that hold the article itself.
REGIONS = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole tokens of class, id and role that name parts beside the article.
BESIDE = re.compile(
    r"ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|disclaimer|footer|form|masthead|menu|nav|navbar|"
    r"navigation|newsletter|notice|notices|popup|promo\w*|related|replies|respond|search|share|sharing|sidebar|signup|"
    r"skip|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|alert|"
    r"(?:cookie|site|privacy)-(?:notice|banner|bar)|(?:comment|comments)-(?:list|area|section|form)|"
    r"(?:related|popular|recent)-(?:posts|articles|stories|links)|(?:share|social|sharing)-(?:buttons|links|icons|bar)|"
    r"(?:ad|ads|advert)-(?:container|wrapper|slot|unit|box|banner)|(?:site|page|main)-(?:footer|nav|navigation|menu)|"
    r"nav-(?:menu|links|bar)|newsletter-(?:form|signup|box)|skip-(?:link|to-content)|search-form|"
    r"(?:user|reader|visitor)-comments|comment-(?:respond|reply)|sidebar-(?:box|widget|area|inner|left|right)|"
    r"(?:share|sharing|social)-(?:list|box)|site-info",
    re.IGNORECASE,
)
#: Names of parts whose own articles are readers' comments.
REPLIES = re.compile(
    r"comments?|replies|respond|disqus|(?:comment|comments)-(?:list|area|section|respond|reply)|"
    r"(?:user|reader|visitor)-comments",
    re.IGNORECASE,
)
#: Whole tokens that name the head of the site where they stand outside the article.
HEADS = frozenset(("header", "site-header"))
#: What a start tag ends, by its group: the open elements that end, and those that are not looked behind.
_PARAGRAPH_ENDS = BLOCKS - frozenset("body caption dd dt html legend li option tbody td tfoot th thead title tr".split())
_ITEMS = BLOCKS - frozenset(("address", "div", "p"))
_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), _ITEMS),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), _ITEMS)),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th", "caption")), frozenset(("table", "tr")))),
    "tr": (frozenset(("tr", "caption")), frozenset(("table", "tbody", "thead", "tfoot"))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(("tbody", "thead", "tfoot", "caption")), frozenset(("table",)))),
}
_P = frozenset(("p",))
_NOT_P = BLOCKS - _P | frozenset(("button", "object"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks that hold the parts of one list, table or paragraph; other blocks hold whole contents.
PARTS = HEADINGS | frozenset(
    "address blockquote caption dd details dl dt figcaption figure hgroup legend li ol option p pre summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Standard deviation of the Gaussian in lines, and the share of the largest smoothed ratio that
#: starts the two clusters' means.
SIGMA = 1.0
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    links: int
    unlinked: bool
    region: int
    block: int
    tag: str


class _Beside:
    """An open or past element that may be left out with all it holds."""

    __slots__ = ("parent", "kind", "holds", "length")

    def __init__(self, parent: int, kind: str) -> None:
        self.parent, self.kind, self.holds, self.length = parent, kind, False, 0


class _Lines(HTMLParser):
    """Parser events to lines, a line per block of text; a start tag ends what HTML lets it end.

    ``linked`` counts the characters in links, ``links`` the links, ``unlinked`` tells of a letter or
    digit outside links, ``block`` is the number of the innermost open block (``blocks`` has the tag
    and the number of the parent of each, 0 is the page) and ``tag`` its element. ``region`` is a
    number that changes with each outermost article or main element; lines outside have region -1.

    Text in skipped elements, and in elements whose class, id or role names a part beside the
    article, makes no line but counts its tags. An element that holds an article or main element is
    not left out; comment lists and templates, whose articles are not the page's, only stay if
    nothing else has text. A form outside them that holds more text than all else is the page and
    stays, as does a form inside if nothing else has text. The work grows with the page: an event costs
    the names of its tag's table at most, however many elements are open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int]] = [("", 0)]
        self._raw: list[tuple[list[tuple[str, int, int]], int, int, int]] = []
        self._besides = [_Beside(0, "page")]
        self._open: list[tuple[str, bool, int, int]] = []
        self._at: dict[str, list[int]] = {}
        self._text: list[tuple[str, int, int]] = []
        self._tags = self._links = self._inside = self._block = self._beside = 0
        self._link = 0
        self._region = -1
        self._regions = 0

    def end_line(self) -> None:
        if self._text:
            self._raw.append((self._text, self._tags, self._region, self._block))
            self._tags = 0
            self._text = []

    def _pop(self) -> str:
        name, region, self._block, self._beside = self._open.pop()
        self._at[name].pop()
        if name == "a":
            self._links -= 1
        if region:
            self._inside -= 1
            if not self._inside:
                self._region = -1
        return name

    def _end_until(self, ends: frozenset[str], bounds: frozenset[str]) -> None:
        """Ends the innermost open element of ``ends``, unless one of ``bounds`` lies above it."""
        last = max((self._at[name][-1] for name in ends if self._at.get(name)), default=-1)
        if last < 0 or any(self._at[name][-1] > last for name in bounds - ends if self._at.get(name)):
            return
        self.end_line()
        while len(self._open) > last:
            self._pop()

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """What an element is that may be left out: form, replies or other; empty if it may not."""
        if tag in REGIONS or tag in ("html", "body"):
            return ""
        keys = ("class", "role") if tag in HEADINGS else ("class", "id", "role")
        tokens = [t for k, v in attrs if v and k in keys for t in v.split()]
        if tag == "template" or any(REPLIES.fullmatch(t) for t in tokens):
            return "replies"
        if tag == "form":
            tokens = [t for t in tokens if t.lower() != "form"]
        if "hidden" in [k for k, _ in attrs] or any(BESIDE.fullmatch(t) for t in tokens):
            return "other"
        if tag == "form":
            return "inner form" if self._inside else "form"
        head = not self._inside and (tag == "header" or any(t.lower() in HEADS for t in tokens))
        return "other" if tag in SKIPPED or head else ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self.end_line()
        if tag in _PARAGRAPH_ENDS:
            self._end_until(_P, _NOT_P)
        if tag in _ENDS:
            self._end_until(*_ENDS[tag])
        if tag == "br":
            self._text.append((" ", self._beside, 0))
        if tag in VOID:
            return
        if tag == "body":  # ends a head that was left open
            self._open, self._at, self._links, self._block, self._beside = [], {}, 0, 0, 0
        if tag == "a":
            self._links += 1
            self._link += 1
        region = tag in REGIONS
        if region:
            above = self._beside
            while above and not self._besides[above].holds:
                self._besides[above].holds = True
                above = self._besides[above].parent
            self._inside += 1
            if self._inside == 1:
                self._region, self._regions = self._regions, self._regions + 1
        self._at.setdefault(tag, []).append(len(self._open))
        self._open.append((tag, region, self._block, self._beside))
        if tag in BLOCKS:
            self.blocks.append((tag, self._block))
            self._block = len(self.blocks) - 1
        if kind := self._kind(tag, attrs):
            self._besides.append(_Beside(self._beside, kind))
            self._beside = len(self._besides) - 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self.end_line()
        if self._at.get(tag):
            while self._pop() != tag:
                pass

    def close(self) -> None:
        if self.rawdata.startswith("<!--"):  # a comment left open goes on to the end
            self.rawdata = ""
        super().close()
        self.end_line()

    def handle_data(self, data: str) -> None:
        self._text.append((data, self._beside, self._link if self._links > 0 else 0))

    def _left_out(self, replies: bool, forms: bool) -> list[bool]:
        """Whether the text of each of the parts is left out; ``replies`` and ``forms`` (in regions): also theirs."""
        besides = self._besides
        form, out = [0] * len(besides), [False] * len(besides)
        for n, b in enumerate(besides[1:], 1):
            gone = (not b.holds or (replies and b.kind == "replies")) and (forms or b.kind != "inner form")
            out[n] = out[b.parent] or (gone and b.kind != "form")
            form[n] = n if gone and b.kind == "form" else form[b.parent]
            b.length = 0
        total = 0
        for text, *_ in self._raw:
            for data, beside, _ in text:
                if not out[beside]:
                    length = len(data.strip())
                    total += length
                    besides[form[beside]].length += length
        for n, b in enumerate(besides[1:], 1):
            out[n] = out[n] or out[b.parent] or (form[n] == n and 2 * b.length <= total)
        return out

    def _lines(self, out: list[bool]) -> list[Line]:
        lines: list[Line] = []
        carried = 0
        for text, tags, region, block in self._raw:
            kept = [(data, link) for data, beside, link in text if not out[beside]]
            joined = _SPACE.sub(" ", "".join(data for data, _ in kept)).strip()
            if not joined:
                carried += tags
                continue
            linked = sum(len(data) for data, link in kept if link)
            links = len({link for data, link in kept if link})
            unlinked = any(c.isalnum() for data, link in kept if not link for c in data)
            lines.append(Line(joined, carried + tags, linked, links, unlinked, region, block, self.blocks[block][0]))
            carried = 0
        return lines

    def lines(self) -> list[Line]:
        lines = self._lines(self._left_out(True, True))
        if not lines and any(b.kind == "inner form" for b in self._besides):
            lines = self._lines(self._left_out(True, False))
        if not lines and any(b.holds and b.kind == "replies" for b in self._besides):
            lines = self._lines(self._left_out(False, True))
        return lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over lines; the weights within the ends of the page sum to one."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return full / weight


def threshold(values: np.ndarray) -> float:
    """The middle between two cluster means, settled by alternating assignment; one cluster if equal."""
    low, high = float(values.min()), float(values.max())
    while True:
        middle = (low + high) / 2
        upper = values >= middle
        if upper.all() or low == high:
            return low
        new_low, new_high = float(values[~upper].mean()), float(values[upper].mean())
        if (new_low, new_high) == (low, high):
            return middle
        low, high = new_low, new_high


def link_heavy(line: Line) -> bool:
    """More than half of the characters are linked; a heading is never link-heavy."""
    return line.tag not in HEADINGS and 2 * line.linked > len(line.text)


def container(blocks: list[tuple[str, int]], starts: set[int]) -> int:
    """The innermost block around all ``starts`` that holds whole contents."""
    below = [0] * len(blocks)
    for block in starts:
        below[block] = 1
    for block in range(len(blocks) - 1, 0, -1):  # a block comes after those around it
        below[blocks[block][1]] += below[block]
    innermost = max(block for block, n in enumerate(below) if n == len(starts))
    while blocks[innermost][0] in PARTS:
        innermost = blocks[innermost][1]
    return innermost


def stretches(lines: list[Line], menu: Callable[[Line], bool]) -> list[Line]:
    """The lines without the stretches of ``menu`` lines that hold two links or more."""
    out: list[Line] = []
    for heavy, stretch in groupby(lines, key=menu):
        part = list(stretch)
        if not heavy or sum(line.links for line in part) < 2:
            out += part
    return out or lines


def around(lines: list[Line], blocks: list[tuple[str, int]], upper: list[bool]) -> list[Line]:
    """The lines of the block container of the content, without its link-heavy parts.

    Content shows in the lines of the upper cluster and in the h1; the container around them stays
    entire, with the headings directly before it. Only stretches of link-heavy lines with two links
    or more are left out.
    """
    seeds = [n for n, line in enumerate(lines) if not link_heavy(line) and (upper[n] or line.tag == "h1")]
    seeds = seeds or [n for n, u in enumerate(upper) if u] or list(range(len(lines)))
    root = container(blocks, {blocks[lines[n].block][1] for n in seeds})
    inside = [False] * len(blocks)
    for block, (_, parent) in enumerate(blocks):
        inside[block] = block == root or inside[parent]
    keep = [inside[line.block] for line in lines]
    first = keep.index(True)
    while first and lines[first - 1].tag in HEADINGS:
        first -= 1
        keep[first] = True
    return stretches([line for line, k in zip(lines, keep) if k], link_heavy)


def upper_cluster(lines: list[Line]) -> list[bool]:
    """Which lines lie in the upper of two clusters of smoothed ratios.

    A ratio counts the unlinked characters to the tags since the line before. Ratios are taken by
    their logarithms, so one long paragraph does not lift the threshold over all others.
    """
    ratios = np.array([(len(x.text) - min(x.linked, len(x.text))) / max(1, x.tags) for x in lines])
    values = smoothed(np.log1p(ratios))
    return (values >= threshold(values)).tolist()


def chosen_lines(lines: list[Line], blocks: list[tuple[str, int]]) -> list[Line]:
    """The lines of the regions that the clustering chooses among articles and the block container.

    The lines of the upper cluster outside every article or main element stand for the container around
    them. It is content if they hold more unlinked characters than all articles hold characters; of the
    articles those with a line of the upper cluster then stay beside it, in the order of the page.
    Otherwise the articles are the content: every one with unlinked text stays whole, those whose
    letters and digits are all linked only where there is no other. List items that are links and
    nothing else, two or more in a row, are a menu also there.
    """
    upper = upper_cluster(lines)
    articles = [line for line in lines if line.region >= 0]
    if not articles:
        return around(lines, blocks, upper)
    apart = sum(len(x.text) - x.linked for x, u in zip(lines, upper) if u and x.region < 0 and not link_heavy(x))
    if apart > sum(len(x.text) for x in articles):
        beside = [(x, u) for x, u in zip(lines, upper) if x.region < 0]
        kept = {id(x) for x in around([x for x, _ in beside], blocks, [u for _, u in beside])}
        regions = {x.region for x, u in zip(lines, upper) if u and x.region >= 0}
        return [x for x in lines if x.region in regions or id(x) in kept]
    regions = {line.region for line in articles if line.unlinked}
    if not regions:
        return articles
    return stretches(
        [line for line in articles if line.region in regions], lambda line: line.tag == "li" and not line.unlinked
    )


def main_text(html: str | None) -> str:
    """The blocks of the chosen regions, joined by two line feeds; empty if there are none.

    On every page each line has a ratio of its unlinked characters to its tags; the ratios are smoothed
    and a threshold splits the lines into two clusters, which choose the regions (``chosen_lines``).
    A chosen region stays whole. Malformed markup is read as far as it goes.
    """
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines()
    return "\n\n".join(line.text for line in chosen_lines(lines, parser.blocks)) if lines else ""


def extract(df: DataFrame, html: str, name: str = "text") -> DataFrame:
    """All other columns of ``df`` with the main text in ``name`` (replacing an older column).

    Null and empty pages have the empty text; repeated rows stay; an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def made(pages):
        return pages.map(main_text, na_action=None)

    return df.withColumn(name, made(F.col(html).cast("string"))).drop(*({html} - {name}))
