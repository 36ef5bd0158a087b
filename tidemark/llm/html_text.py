"""Main text of web pages by text-to-tag ratios over streamed parser events.

A page becomes lines: one per block of text, each with its characters, its tags and the elements
it stands in. The ratio of characters to tags is smoothed over neighbouring lines by a Gaussian,
and a threshold between the two clusters of smoothed ratios marks content lines. The region of
the page that holds the marked text is then taken as a whole, so that short paragraphs between
long ones stay, without the parts that by their element or name are not article text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Never article text.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select textarea option iframe object svg canvas menu dialog audio video map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
#: Words in a class or id that name such parts.
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|sponsor(?:ed|s)?|promo(?:tions?)?|sidebars?|widgets?|related[-_](?:posts?|articles?|stories|links|news|content|items|reading|topics)|recommended|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|header|masthead|footer|comments?|commentlist|respond|replies|disqus|"
    r"cookies?|consent|gdpr|notices?|notifications?|alerts?|banners?|popups?|modals?|overlay|newsletter|subscribe|signup|login|share|sharing|social|toolbar|skip)(?:$|[-_\s\d])"
    r"|(?:^|\s)(?:side|related)(?:$|\s)",
    re.I,
)
CONTENT = frozenset(["article", "main"])
#: A part is only named away if it holds at most this share of the page's text.
NAMED_SHARE = 0.5
#: Articles of a page that hold less than this part of the largest one's marked text are teasers.
TEASER = 0.2
_CLOSED_BY_BLOCK = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6"])
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Lines(HTMLParser):
    """Collects (text, tags, characters inside links, path of open blocks) per line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.open: list[tuple[str, bool, int]] = []  # name, dropped, number
        self.tag: dict[int, str] = {}  # of the open blocks' numbers that count: article, main and h1
        self.named: set[int] = set()  # numbers of the blocks that NAMES would drop
        self.number = self.tags = self.linked = self.depth = self.anchors = 0
        self.parts: list[str] = []

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple(n for tag, _, n in self.open if tag not in INLINE)
            self.lines.append((text, max(1, self.tags), self.linked, path))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _running(self) -> bool:
        """Whether an inline element here belongs to a main heading or to a sentence that has begun."""
        inside = {t for t, _, _ in self.open}
        return "h1" in inside or ("p" in inside and any(x.strip() for x in self.parts))

    def _unwanted(self, tag: str, attrs: list) -> bool:
        if tag in DROPPED or (tag == "header" and not any(t in CONTENT for t, _, _ in self.open)):
            return True
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if value and (
                (name in ("class", "id") and tag in INLINE and not self._running() and NAMES.search(value))
                or (name == "role" and value.lower() in ROLES)
                or (name == "style" and _HIDDEN.search(value))
            ):
                return True
        return False

    def _pop(self, k: int) -> None:
        for tag, dropped, _ in self.open[k:]:
            self.depth -= dropped
            self.anchors -= tag == "a"
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            return
        if tag not in INLINE:
            self._end_line()
            for k in range(len(self.open) - 1, -1, -1):
                name = self.open[k][0]
                if name in _CLOSED_BY_BLOCK or (name == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                    self._pop(k)
                    break
                if name not in INLINE:
                    break
        dropped = self._unwanted(tag, attrs)
        self.number += 1
        if tag in CONTENT or tag == "h1":
            self.tag[self.number] = tag
        if tag not in INLINE and tag not in ("html", "body") and any(v and n in ("class", "id") and NAMES.search(v) for n, v in attrs):
            self.named.add(self.number)
        self.depth += dropped
        self.anchors += tag == "a"
        self.open.append((tag, dropped, self.number))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_line()


def smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with the edges' weights scaled to one."""
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel, "full")[reach:-reach] / np.convolve(np.ones(len(ratio)), kernel, "full")[reach:-reach]


def threshold(values: np.ndarray) -> float:
    """Between the two clusters of one-dimensional 2-means; the values themselves if they do not differ."""
    low, high = float(values.min()), float(values.max())
    while low < high:
        cut = (low + high) / 2
        a, b = values[values <= cut].mean(), values[values > cut].mean()
        if a == low and b == high:
            return cut
        low, high = float(a), float(b)
    return low


def without_named_parts(parser: _Lines) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """The lines outside blocks whose name says they are not article text.

    A name alone does not drop a block with over NAMED_SHARE of the page's text, nor one that
    is or holds the page's main element, its largest article or an h1.
    """
    lines = parser.lines
    if not parser.named:
        return lines
    held: dict[int, int] = {}
    for text, _, _, path in lines:
        for n in path:
            held[n] = held.get(n, 0) + len(text)
    articles = [n for n, tag in parser.tag.items() if tag == "article" and n in held]
    largest = max(articles, key=held.get, default=None)
    whole = {n for n in held if parser.tag.get(n) in ("main", "h1")} | {largest}
    safe = {n for *_, path in lines for k, n in enumerate(path) if n in parser.named and whole & set(path[k:])}
    total = sum(len(t) for t, *_ in lines)
    dropped = {n for n in parser.named if n not in safe and held.get(n, 0) <= NAMED_SHARE * total}
    kept, tags = [], 0
    for text, n, linked, path in lines:
        if dropped.isdisjoint(path):
            kept.append((text, n + tags, linked, path))
            tags = 0
        else:
            tags += n
    return kept


def main_text(html: str, sigma: float = 1.0, share: float = 0.6, whole: float = 0.95) -> str:
    """The article text of a page; empty if there is none.

    If the outermost article and main elements hold at least `share` of the marked text, they are
    the region, without those that are teasers beside the largest. Else the walk from the page's
    root goes down as long as one element holds `whole` of the marked text, so that an article's
    lists, quotes and sections stay together. A region without an h1 takes the h1 before it.
    Lines there that are mostly links and not marked are left out.
    """
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = without_named_parts(parser)
    if not lines:
        return ""
    ratio = np.array([len(t) / n for t, n, _, _ in lines])
    level = smooth(ratio, sigma)
    marked = level >= min(threshold(level), level.max())
    weight = np.where(marked, [len(t) for t, *_ in lines], 0)
    outer = [next((n for n in path if parser.tag.get(n) in CONTENT), None) for *_, path in lines]
    held: dict[int, int] = {}
    for n, w in zip(outer, weight.tolist()):
        if n is not None:
            held[n] = held.get(n, 0) + w
    if held and sum(held.values()) >= share * weight.sum():
        inside = np.array([n is not None and held[n] >= TEASER * max(held.values()) for n in outer])
    else:
        inside = np.ones(len(lines), bool)
        depth = 0
        while True:
            held = {}
            for k in np.flatnonzero(inside).tolist():
                path = lines[k][3]
                if len(path) > depth:
                    held[path[depth]] = held.get(path[depth], 0) + int(weight[k])
            best = max(held, key=held.get, default=None)
            below = np.array([best is not None and len(p) > depth and p[depth] == best for *_, p in lines]) & inside
            if best is None or below.sum() < 2 or held[best] < whole * weight[inside].sum():
                break
            inside, depth = below, depth + 1
    titles = [k for k, (*_, path) in enumerate(lines) if any(parser.tag.get(n) == "h1" for n in path)]
    first = int(np.argmax(inside))
    if not any(inside[k] for k in titles):
        before = [k for k in titles if k < first and parser.named.isdisjoint(lines[k][3])]
        inside[before[-1:]] = True
    return " ".join(t for k, (t, _, linked, _) in enumerate(lines) if inside[k] and (marked[k] or 2 * linked <= len(t)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) per row of `pages`.

    A null or empty page, and one without article text, has an empty text; null ids and urls are
    kept; repeated rows give repeated results; an empty table gives an empty result. Each page is
    read whole in one task and needs memory in proportion to its length.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for s in range(0, f.num_rows, 256):
                part = f.slice(s, 256)
                found = [main_text(t.decode("utf-8", "replace")) for t in texts(part, "html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], schema=schema)

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
