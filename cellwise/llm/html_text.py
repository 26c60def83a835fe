"""Main text of web pages by line-block distribution: lengths of text lines summed over sliding windows, surges and dives."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element names by their roles, and words of class, id and role attributes.
#: Content of these is not text; it ends at the same end tag whatever stands between.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "datalist")
#: Containers of boilerplate.
BOILERPLATE = frozenset(("nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset"))
#: Elements that begin and end a line.
BLOCKS = frozenset(
    (
        "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody "
        "td tfoot th thead title tr ul"
    ).split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an open p ends at.
ENDS_P = BLOCKS - frozenset(("br", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "summary", "legend", "figcaption", "body", "html", "head", "title"))
#: Words of class, id and role attributes that name parts of a page beside its article.
MARKS = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist "
        "consent cookie cookies copyright disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
        "notices overlay pagination pager popup promo promoted promotion recommended related respond responses replies reply share sharing sidebar "
        "sidenav signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets alert toc"
    ).split()
)
#: Words that stand beside them in compound names: places and shapes. Any other word makes a name of the author's own.
BESIDE = frozenset(
    (
        "site page top left right bottom global primary secondary reader readers user users posts post articles links link stories list lists item items "
        "button buttons bar box block icon icons media section area inner outer wrap wrapper container content block group form thread row column col slot unit "
        "text title main byline"
    ).split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements in which an author sets out blocks that belong together.
CONTAINERS = frozenset("article blockquote center div main section table td".split())

#: Attributes of a tag: a quoted value only after an equals sign, so that a lone quote is a character.
INSIDE_TAG = r"(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b" + INSIDE_TAG + r"(?:(?<=/)>|>.*?(?:</(?P=raw)\s*[^>]*>|\Z)|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>" + INSIDE_TAG + r")(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|=\s*(?:\"[^\"]*\"|'[^']*')")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")


def _marks(token: str) -> bool:
    """Whether a class or id names boilerplate: a mark, or marks with words of place and shape ("site-footer", "related-posts").

    A name with any other word is about content or layout: "related-work", "social-science", "has-sidebar".
    """
    words = WORD.findall(token)
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in BESIDE for w in words)


def is_boilerplate(name: str, attributes: str) -> bool:
    """Whether an element's name, class, id, role or hiding marks it as no part of an article. Ids of headings are their slugs."""
    if name in BOILERPLATE:
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "").lower(), next((x for x in m.groups()[1:] if x is not None), "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDING.search(value) or key == "role" and value.strip() in ROLES:
            return True
        if (key == "class" or key == "id" and name not in HEADINGS) and any(map(_marks, value.split())):
            return True
    return False


@dataclass
class Line:
    text: str
    inside: bool  # within an article or main element
    boilerplate: bool
    linked: int = 0  # characters within links
    container: int = 0  # number of the innermost container that it stands in; 0 is the page itself


class _Open:
    """The open elements, with counts that answer in one step what an end tag closes."""

    def __init__(self) -> None:
        self.stack: list[tuple] = []  # name, whether boilerplate, whether an article, container, blocks and other blocks than p up to it
        self.places: dict[str, list[int]] = {}
        self.bad = self.within = self.links = self.made = 0

    @property
    def container(self) -> int:
        return self.stack[-1][3] if self.stack else 0

    def blocks(self, k: int, at: int | None = None) -> int:
        """Blocks (k 4), or those that are no p (k 5), among the elements up to place `at`, or among all."""
        at = len(self.stack) - 1 if at is None else at
        return self.stack[at][k] if at >= 0 else 0

    def push(self, name: str, marked: bool, article: bool) -> None:
        container = self.container
        if name in CONTAINERS:
            self.made += 1
            container = self.made
        block = name in BLOCKS
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, marked, article, container, self.blocks(4) + block, self.blocks(5) + (block and name != "p")))
        self.bad, self.within, self.links = self.bad + marked, self.within + article, self.links + (name == "a")

    def last(self, name: str) -> int | None:
        found = self.places.get(name)
        return found[-1] if found else None

    def close(self, down_to: int) -> None:
        while len(self.stack) > down_to:
            name, marked, article, *_ = self.stack.pop()
            self.places[name].pop()
            self.bad, self.within, self.links = self.bad - marked, self.within - article, self.links - (name == "a")


def text_lines(html: str) -> list[Line]:
    """The page's lines: text between block tags, markup stripped, references decoded, white space made one space.

    Elements left open end with their parent; an end tag without a start is passed over. One pass, whatever stays open.
    """
    lines: list[Line] = []
    parts: list[str] = []
    now = _Open()
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = "".join(parts)
            text = " ".join((unescape(joined) if "&" in joined else joined).split())
            if text:
                lines.append(Line(text, now.within > 0, now.bad > 0, linked, now.container))
            parts.clear()
            linked = 0

    at = 0
    while at < len(html):
        begin = html.find("<", at)
        begin = len(html) if begin < 0 else begin
        m = TOKEN.match(html, begin)
        while m is None and begin < len(html):  # a sign, not a tag
            begin = html.find("<", begin + 1)
            begin = len(html) if begin < 0 else begin
            m = TOKEN.match(html, begin)
        if begin > at:
            parts.append(html[at:begin])
            linked += begin - at if now.links else 0
        if m is None:
            break
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() in BLOCKS:
                flush()
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in BLOCKS:
            flush()
        if m["end"]:
            place = now.last(name)
            # An inline end tag does not end blocks.
            if place is not None and (name in BLOCKS or now.blocks(4) == now.blocks(4, place)):
                now.close(place)
        elif name not in VOID:
            if name in ENDS_P:
                place = now.last("p")
                if place is not None and now.blocks(5) == now.blocks(5, place):
                    now.close(place)
            marked = is_boilerplate(name, m["attributes"])
            now.push(name, marked, name in ("article", "main") and not now.bad)
    flush()
    return lines


def blocks_between(lengths: np.ndarray, window: int, surge: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(first, end) of the runs of lines between dives: those that surge, and the others.

    The sum at a line covers it and the window - 1 lines after it. A dive is a line from which a whole window is empty; a
    run goes from the first line with text after a dive to the last one before the next, and surges if a sum in it
    reaches `surge`.
    """
    padded = np.concatenate((np.zeros(1, dtype=np.int64), lengths, np.zeros(window, dtype=np.int64)))
    sums = np.lib.stride_tricks.sliding_window_view(padded, window).sum(axis=1)  # at place i: that of line i - 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (sums > 0).astype(np.int8), [0]))))
    high, low = [], []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        full = np.flatnonzero(padded[a : b + window - 1])
        run = (a + int(full[0]) - 1, a + int(full[-1]))
        (high if sums[a:b].max() >= surge else low).append(run)
    return high, low


def main_text(html: str | None, window: int = 3, surge: int = 86) -> str:
    """The article of a page, a line for each block.

    Lines of boilerplate are left out before lengths are summed, so an advert does not cut an article. Where the page has
    an article or main element, only its lines count. Elsewhere a line that is mostly links has no length, so menus are
    dives; what stands between dives is kept if it surges to `surge` characters within `window` lines, or if one of its
    lines stands in the same container as a line of such a run. If nothing surges, the tallest window does. Nothing
    between a surge and its dives is dropped. Null, empty or text-free pages give the empty string.
    """
    lines = [x for x in text_lines(html or "") if not x.boilerplate]
    if marked := any(x.inside for x in lines):
        lines = [x for x in lines if x.inside]
    lengths = np.array([0 if not marked and 2 * x.linked > len(x.text) else len(x.text) for x in lines], dtype=np.int64)
    if not lengths.any():
        return ""
    high, low = blocks_between(lengths, window, surge)
    if not high:
        sums = np.convolve(lengths, np.ones(window, dtype=np.int64))
        high, low = blocks_between(lengths, window, int(sums.max()))
    homes = {lines[i].container for a, b in high for i in range(a, b)} - {0}
    kept = high + [(a, b) for a, b in low if any(lines[i].container in homes for i in range(a, b))]
    return "\n".join(lines[i].text for a, b in sorted(kept) for i in range(a, b))


def _extracted(batches: Iterator[pa.RecordBatch], window: int, surge: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(h.as_py(), window, surge) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", window: int = 3, surge: int = 86) -> DataFrame:
    """(page_id, url, text, n_chars) of each row; null ids and urls stay null, null pages have an empty text.

    Repeated rows stay; pages of any length are read whole, one at a time; an empty table gives no rows.
    """
    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return slim.mapInArrow(lambda b: _extracted(b, window, surge), "page_id long, url string, text string, n_chars long")
