"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, in page order. Names of elements and classes only
describe a line: it may lie in a suspect region (menu, form, advert, comments and the like) and in an article element.
The sums of text lengths over sliding windows of lines surge where a text begins and dive where it ends; the run
with most text between a surge and a dive is the article's core. A suspect region is left out if the core lies
outside it: one that holds most of the page's text, a heavier article element, or the only text that
surges, is a wrapper and its lines count like others. Where article elements hold the core, the one with most of
it is kept whole, short lines at its edges too; otherwise the text of every run that surges is kept, unless most
of it is links. Reading a page takes time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

WINDOW = 3  # lines summed
SURGE = 80  # characters in a window where a text begins

# Names of HTML elements.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr td th".split())
# Elements that hold no article, and those that may be wrapped around one.
DROPPED = frozenset("nav footer aside menu dialog button".split())
FORMS = frozenset("form fieldset".split())
_SIBLINGS = frozenset("li tr dt dd option".split())
_SCOPES = frozenset("ul ol table dl div section article main blockquote".split())
ARTICLE = frozenset("article main".split())
# Elements that a mark can name as a region; headings, paragraphs, items and inline elements are content.
CONTAINERS = frozenset("div section ul ol dl table header article main center details".split())
# Words that mark regions outside the article, as a whole name of class, id or role or as its first word.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert "
    "comment comments commentlist disqus respond reply replies discussion sidebar aside menu navbar nav navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing "
    "social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager copyright contentinfo complementary search skip".split()
)
# Of these, words that also head ordinary names ("search-algorithms"): they mark as a whole class or role only.
ORDINARY = frozenset("alert aside banner comment copyright discussion login menu notice notices notification overlay related replies reply respond search share sharing skip social widget".split())
# Words by which a name says something of an element that is not the region itself.
_OF = frozenset("no not non has have with without hide show is are enabled disabled open free after before above below".split())
# Regions that may hold more text than the article does.
_LONG = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
_NO_ARTICLE = frozenset("comment comments ad ads advert sponsored promo related".split())
_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/)?(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|$)|<[!?/][^>]*+(?:>|$)""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?=[\s=/>]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass(slots=True)
class Line:
    """One block of the page; `article` numbers the article element that it is in, 0 for none."""

    text: str
    length: int  # characters outside links
    article: int
    heading: bool
    region: int  # the innermost suspect region, 0 for none


@dataclass(slots=True)
class Region:
    """A suspect part of a page, inside region `parent`; `hard` ones hold no article whatever is in them."""

    parent: int
    hard: bool
    long: bool  # may have more text than the article (comments)
    holds: bool = False  # an article element, not through a hard region
    chars: int = 0  # outside links, with all regions in it
    kept: bool = False


def _marks(element: str, attrs: str) -> tuple[frozenset[str], bool, bool]:
    """Marks by class, id and role; whether the element is hidden; whether it is an article's body.

    A name marks as a whole or by its first or last word ("site-footer"), but not by one that it says something
    of ("no-sidebar"). Articles mark as a whole only, and the last word of a section's id is a word of its title.
    """
    parts = element not in ARTICLE
    words, hidden, body = set(), False, False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "itemprop":
            body |= value.lower() == "articlebody"
        else:
            for token in value.split():
                whole = token.lower()
                if whole in MARKS and (name != "id" or whole not in ORDINARY):
                    words.add(whole)
                elif whole == "header":
                    words.add(whole)
                elif parts and (found := [x.lower() for x in _WORD.findall(token)]) and not _OF.intersection(found):
                    ends = {found[0]} if token[0].isalpha() else set()
                    if name != "id" or element != "section":
                        ends.add(found[-1])
                    words |= (ends & MARKS) - ORDINARY
            body |= name == "role" and value.lower() == "main"
    return frozenset(words), hidden, body


class _Open:
    """The open elements of a page. Each scope counts what is open in it, so that no search walks the stack in vain."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = []  # name, article, region
        self.count: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]

    def push(self, name: str, article: int, region: int) -> None:
        self.stack.append((name, article, region))
        self.count[name] = self.count.get(name, 0) + 1
        if name in _SCOPES:
            self.scopes.append({})
        elif name == "p" or name in _SIBLINGS:
            self.scopes[-1][name] = self.scopes[-1].get(name, 0) + 1

    def close(self, names: tuple[str, ...]) -> tuple[int, int]:
        """Close elements up to the innermost one of these names; article and region of what is left open."""
        while True:
            name, _, _ = self.stack.pop()
            self.count[name] -= 1
            if name in _SCOPES:
                self.scopes.pop()
            elif name in self.scopes[-1]:
                self.scopes[-1][name] -= 1
            if name in names:
                return self.stack[-1][1:] if self.stack else (0, 0)

    def ended_by(self, name: str) -> tuple[str, ...]:
        """What the start of a block ends in its scope: an open paragraph; a list item, row or term also one of its kind."""
        own = self.scopes[-1]
        return tuple(x for x in (("p", name) if name in _SIBLINGS else ("p",)) if own.get(x))


def lines(page: str) -> tuple[list[Line], list[Region]]:
    """The blocks of a page, and its suspect regions (the first one stands for none); a region begins with a line without text."""
    out: list[Line] = []
    regions = [Region(0, False, False, kept=True)]
    open_ = _Open()
    pieces: list[str] = []
    linked: list[str] = []
    article = articles = region = links = 0
    heading = False

    def flush() -> None:
        nonlocal heading
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Line(text, max(0, len(text) - len(" ".join("".join(linked).split()))), article, heading, region))
            pieces.clear()
            linked.clear()
        heading = False

    def add(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                linked.append(text)

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if name is None:
            continue
        name = name.lower()
        if found["close"] or found["close2"]:
            if name == "a":
                links = max(0, links - 1)
            if name not in INLINE:
                flush()
            elif name in ("td", "th"):
                add(" ")
            if open_.count.get(name):
                left = open_.close((name,))
                if left != (article, region):
                    flush()
                article, region = left
            continue
        if name in RAW:
            flush()
            if name != "head" and not (name in ("svg", "math") and page[at - 2] == "/"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else size
            continue
        if name in INLINE:
            if name in ("br", "td", "th"):
                add(" ")
            elif name == "a":
                links += 1
        else:
            flush()
            links = 0
            if ended := open_.ended_by(name):
                article, region = open_.close(ended)
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in VOID:
            continue
        inside, within = article, region
        if name not in ("html", "body"):
            words, hidden, body = _marks(name, found["attrs"] or found["attrs2"] or "")
            marks = words & (MARKS if name not in ARTICLE else _NO_ARTICLE) if name in CONTAINERS else frozenset()
            header = name in CONTAINERS and (name == "header" or "header" in words) and not inside and name not in ARTICLE
            hard = hidden or name in DROPPED
            if hard or marks or header or name in FORMS:
                flush()
                within = len(regions)
                regions.append(Region(region, hard, bool(marks & _LONG)))
                out.append(Line("", 0, inside, False, within))
            elif name in ARTICLE or body:
                articles += 1
                inside = articles
                regions[region].holds = True
        open_.push(name, inside, within)
        article, region = inside, within
    flush()
    return out, regions


def lengths_of(found: list[Line], regions: list[Region]) -> np.ndarray:
    """Characters outside links of each line, 0 in regions that are not kept."""
    return np.array([x.length if regions[x.region].kept else 0 for x in found], float)


def spare(found: list[Line], regions: list[Region]) -> None:
    """Mark the suspect regions that are wrapped around the text as kept.

    Parents come before what is in them, so each rule is one walk over the regions.
    """
    in_articles = [0] * len(regions)
    for x in found:
        regions[x.region].chars += x.length
        if x.article:
            in_articles[x.region] += x.length
    for k in range(len(regions) - 1, 0, -1):
        r = regions[k]
        regions[r.parent].chars += r.chars
        in_articles[r.parent] += in_articles[k]
        regions[r.parent].holds |= r.holds and not r.hard
    whole = regions[0].chars
    for r in regions[1:]:
        r.kept = regions[r.parent].kept and not r.hard and not r.long and 2 * r.chars > whole
    lengths = lengths_of(found, regions)
    a, b = core(lengths)
    heaviest = lengths[a:b].sum()
    for k, r in enumerate(regions[1:], 1):
        r.kept = r.kept or (regions[r.parent].kept and not r.hard and r.holds and in_articles[k] >= heaviest)
    lengths = lengths_of(found, regions)
    if len(runs(lengths)) and _sums(lengths, WINDOW).max() >= SURGE:
        return
    # nothing surges: the heaviest region with a text that does, comments last, and what fills most of it
    left = [r for r in regions[1:] if regions[r.parent].kept and not r.kept and not r.hard and r.chars >= SURGE]
    if left:
        top = max(left, key=lambda r: (not r.long, r.chars))
        top.kept = True
        for r in regions[1:]:
            r.kept = r.kept or (regions[r.parent].kept and not r.hard and not r.long and 2 * r.chars > top.chars)


def _sums(lengths: np.ndarray, window: int) -> np.ndarray:
    """The sum of the window around each line."""
    padded = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(window // 2), lengths, np.zeros(window)]))])
    return (padded[window:] - padded[:-window])[: len(lengths)]


def runs(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """The runs [a, b) of lines between a surge and a dive of the window sums, in page order.

    A surge is a window with `surge` characters or more (or the largest sum, if no window has so many);
    the run goes on both ways until a window without text.
    """
    n = len(lengths)
    if not n or not lengths.any():
        return []
    sums = _sums(lengths, window)
    out, i = [], 0
    least = min(surge, float(sums.max()))
    while i < n:
        if sums[i] <= 0:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        if sums[i:j].max() >= least:
            out.append((i, j))
        i = j
    return out


def core(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """The run of lines with most text; the first of equal ones."""
    return max(runs(lengths, window, surge), key=lambda r: float(lengths[r[0] : r[1]].sum()), default=(0, 0))


def _article(found: list[Line], lengths: np.ndarray) -> int:
    """The article element that holds most of the core, 0 if there is none.

    Several elements without a surge (teasers) are none where the text outside them surges.
    """
    inside = np.array([x.article for x in found])
    if not any(x.article and x.text for x in found):
        return 0
    own = np.where(inside > 0, lengths, 0)
    if len(np.unique(inside[inside > 0])) > 1 and _sums(own, WINDOW).max() < SURGE <= _sums(np.where(inside > 0, 0, lengths), WINDOW).max():
        return 0
    if not own.any():
        own = np.array([len(x.text) if x.article else 0 for x in found], float)
    a, b = core(own)
    weight: dict[int, float] = {}
    for k in range(a, b):
        if inside[k]:
            weight[inside[k]] = weight.get(inside[k], 0) + own[k]
    return int(max(weight, key=lambda k: (weight[k], -k)))


def extract(page: str | None) -> str:
    """Main text of a page: its blocks, white space collapsed, joined by empty lines; "" if none or null."""
    if not page:
        return ""
    found, regions = lines(page)
    spare(found, regions)
    for x in found:
        if not regions[x.region].kept:
            x.text, x.length = "", 0
    lengths = np.array([x.length for x in found], float)
    if top := _article(found, lengths):
        own = [k for k, x in enumerate(found) if x.article == top]
        # articles nested in it are numbered later and lie between its lines
        kept = [x for x in found[own[0] : own[-1] + 1] if x.article >= top and x.text]
    else:
        kept, last, heaviest = [], 0, core(lengths)
        for a, b in runs(lengths):
            if (a, b) != heaviest and 2 * lengths[a:b].sum() < sum(len(x.text) for x in found[a:b]):
                continue  # mostly links
            while a > last and found[a - 1].text and found[a - 1].heading:
                a -= 1
            run = [x for x in found[a:b] if x.text]
            while run and not run[0].length and not run[0].heading:
                run.pop(0)
            while run and not run[-1].length:
                run.pop()
            kept += run
            last = b
    return "\n\n".join(x.text for x in kept)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract_pages(df: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a null page has an empty text, other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")).mapInArrow(run, EXTRACTED)
