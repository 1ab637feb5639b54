"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page; what stands in
boilerplate elements goes with it. Every other line has the length of its text,
zero if it is mostly links; where an article holds most of the text, lines in it
weigh more and those outside are taken run by run. Lengths are summed over sliding windows of the lines that have
one. The text of a run begins at the surge point, the first line from which the sum
reaches the threshold, and ends at the dive point, the last line up to which it
does; lines with a length between the two are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.text import map_batches

# Element names by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("head nav footer aside form noscript template select button iframe object svg canvas dialog menu fieldset audio video map".split())
RAW = frozenset(("script", "style", "title", "textarea", "xmp"))
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|toolbar|footer|masthead|site-?header|page-?header|top-?bar|"
    r"share|sharing|social|related|recommended|widget|comments?|respond|replies|disqus|pagination|pager|tags|copyright|legal|disclaimer|skip)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<(?P<broken>/?[a-zA-Z][^>]*)(?:>|\Z)",  # a quote that nothing closes
    re.S,
)
_BROKEN = re.compile(r"(/?)([a-zA-Z][^\s/>]*)(.*)", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
#: Where an article holds most of the text, its characters count so many times.
ARTICLE = 128
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


def _is_boiler(name: str, attr: str, in_article: bool) -> bool:
    if name in BOILER or name == "header" and not in_article:
        return True
    if name in ("html", "body", "main") or not attr or attr.isspace():
        return False
    for key, *values in _ATTR.findall(attr):
        value = next((v for v in values if v), "")
        key = key.lower()
        # an article carries its topics as classes ("category-social"): only a whole class counts
        hint = any(map(HINTS.fullmatch, value.split())) if name == "article" else HINTS.search(value)
        if key in ("class", "id") and hint or key == "role" and value.lower() in ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters within links, boilerplate?, in article or main?) of each non-empty block in page order."""
    lines: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements and whether each is boilerplate
    blocks: list[int] = []  # where the stack holds elements that are not inline
    count: Counter[str] = Counter()  # open elements by name, so that a stray closing tag is known at once
    parts: list[str] = []
    linked: list[str] = []
    boiler = 0
    raw = None

    def close_line() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append((text, len(" ".join(html.unescape("".join(linked)).split())), boiler > 0, count["article"] + count["main"] > 0))
        parts.clear()
        linked.clear()

    def leave(k: int) -> None:
        nonlocal boiler
        for name, bad in stack[k:]:
            boiler -= bad
            count[name] -= 1
        del stack[k:]
        while blocks and blocks[-1] >= k:
            blocks.pop()

    at = 0
    while at < len(page):
        if raw:
            end = _RAW_END[raw].search(page, at)
            at, raw = (end.start() if end else len(page)), None
            continue
        token = _TOKEN.search(page, at)
        piece = page[at : token.start() if token else len(page)]
        if piece:
            parts.append(piece)
            if count["a"]:
                linked.append(piece)
        if not token:
            break
        at = max(token.end(), token.start() + 1)
        close, name, attr = token["close"], token["name"], token["attr"]
        if token["broken"]:
            close, name, attr = _BROKEN.match(token["broken"]).groups()
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            close_line()
        if close:
            if count[name]:
                leave(next(k for k in reversed(range(len(stack))) if stack[k][0] == name))
            continue
        if name in RAW:
            raw = name
            continue
        if name in VOID or attr.endswith("/") and name not in BOILER:
            continue
        if blocks and stack[blocks[-1]][0] == ("li" if name == "li" else "p") and (name == "li" or name in _CLOSES_P):
            leave(blocks[-1])
        bad = _is_boiler(name, attr, count["article"] + count["main"] > 0)
        if name not in INLINE:
            blocks.append(len(stack))
        stack.append((name, bad))
        boiler += bad
        count[name] += 1
    close_line()
    return lines


def main_text(page: str | None, window: int = 3, share: float = 0.125, most: int = 120) -> str:
    """Blocks of the main text, joined by two line feeds; empty if there is none.

    The threshold of the window sums is ``share`` of the largest one, ``most`` at
    most; a title or a closing line shares its window with the paragraphs beside it.
    Where marked articles hold most of the length, their lines weigh so much that
    each reaches the threshold, and every run of lines before, between and after
    them has a surge and a dive of its own: a second part keeps its heading and
    its closing line, and a short line by itself goes. Time is linear in the page."""
    lines = lines_of(page or "")
    if not lines:
        return ""
    size = np.array([0 if bad else len(text) for text, _, bad, _ in lines])
    inside = np.array([here for *_, here in lines])
    links = np.array([min(1.0, n / len(text)) for text, n, *_ in lines])
    size = np.where(~inside & (links > 0.5), 0, size)
    marked = 2 * size[inside].sum() > size.sum()
    at = np.flatnonzero(size)
    if not len(at):
        return ""
    size, inside = size[at], inside[at]
    threshold = min(share * _ahead(size, window).max(), most)
    if not marked:
        runs = [(0, len(at))]
    else:
        size = np.where(inside, size * ARTICLE, size)
        edges = np.r_[0, np.flatnonzero(np.diff(inside)) + 1, len(at)].tolist()
        runs = list(zip(edges, edges[1:]))
    kept = []
    for a, b in runs:
        surge, dive = np.flatnonzero(_ahead(size[a:b], window) >= threshold), np.flatnonzero(_ahead(size[a:b][::-1], window)[::-1] >= threshold)
        if len(surge):
            kept += at[a + surge[0] : a + dive[-1] + 1].tolist()
    return "\n\n".join(lines[j][0] for j in kept)


def _ahead(size: np.ndarray, window: int) -> np.ndarray:
    """Sums of the windows that begin at each line."""
    total, k = np.r_[0, np.cumsum(size)], np.arange(len(size))
    return total[np.minimum(k + window, len(size))] - total[k]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row. Null, empty and
    broken html give what text there is, or the empty string; very long pages
    are read whole; repeated rows are returned as often as they occur; only page_id, url and html are read."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = [main_text(h) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_pydict(
            {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())}
        )

    return map_batches(pages.select("page_id", F.col("url").cast("string").alias("url"), "html"), lambda: each, "page_id long, url string, text string, n_chars long")
