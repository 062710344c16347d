"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block; scripts, forms, navigation and parts that are named as adverts, comments and the like
are left out.  Text lengths are summed over sliding windows of lines.  Where the sums first surge the text begins, where they last
dive it ends, and what stands between is kept, whatever elements it is in.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labcurate.llm.common import bounded_batches, small_batches

#: Lines in a window, and the sum of text lengths that makes a surge.
WINDOW = 3
SURGE = 50
#: A line of so many characters outside links is text at the ends of a surge, as is one that ends like a sentence.
LONG = 40
#: The title may stand so many lines before the text; so many lines of links in a row are a menu within it.
TITLE, MENU = 6, 3

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_TAG_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")  # findall reads name by name, each with its whole value
# Names of blocks, of parts that are never the article, and words in classes and ids that say so.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_NESTED = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header html main menu nav ol section table td tr ul".split())
_NEVER = frozenset("aside audio button canvas dialog footer form head label menu nav video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe math noscript object script select style svg template textarea title".split())
_AROUND = frozenset("html head body div section p".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# A class or id says that a part is not text if all its words do or say nothing, and one does.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget".split()
)
_PLAIN_WORDS = frozenset("area bar block bottom box button buttons container content form global group icon icons inner item items left link links list main media outer page policy post posts primary right secondary section site slot thread top unit widget wrap wrapper".split())
_SITE_HEADERS = frozenset("site-header siteheader site-head".split())
_PARTS = re.compile(r"[-_]+")
_SIZE = re.compile(r"\d+(?:x\d+)?")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][^\w\s]*\Z")
_LEGAL = re.compile(r"\A\u00a9")


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    level: int  # of a heading, else 0

    @property
    def own(self) -> int:
        """Characters outside links; 0 where most are inside, and for a line that begins with a copyright sign."""
        return 0 if 2 * self.linked > len(self.text) or _LEGAL.search(self.text) else len(self.text) - self.linked


def _says_so(names: str) -> bool:
    for name in names.lower().split():
        parts = [p for p in _PARTS.split(name) if p]
        if name in _SITE_HEADERS or any(p in _WORDS for p in parts) and all(p in _WORDS or p in _PLAIN_WORDS or _SIZE.fullmatch(p) for p in parts):
            return True
    return False


def _unwanted(name: str, attributes: str, parent: str) -> bool:
    """Whether an element begins a part that is not text: by its kind, its role, being hidden, or what it is named.  A header is one of
    the page, not of an article, where the page itself holds it."""
    if name in _NEVER or name == "header" and parent in ("", "html", "body"):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and _says_so(value) or key == "role" and value.lower() in _ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text before, tag name, attributes, closing) tag after tag; the last has no name.  Comments and raw elements are passed over.

    Time is linear in the page: a quote or tag that never ends is met once, and from then on tags end at the next ``>``.
    """
    start = at = 0
    quotes = True
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            yield page[start:lt], "", "", False
            start = at = len(page) if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            if end < 0:
                break
            yield page[start:lt], "", "", False
            start = at = end + 1
            continue
        closing = page.startswith("/", lt + 1)
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            at = lt + 1
            continue
        end = name.end()
        while quotes:
            stop = _TAG_STOP.search(page, end)
            end = stop.start() if stop else -1
            if end < 0 or page[end] == ">":
                break
            end = page.find(page[end], end + 1) + 1
            if not end:
                end = -1
                break
        if not quotes or end < 0:
            quotes = False
            end = page.find(">", name.end())
        if end < 0:
            break
        attributes, low = page[name.end() : end], name[0].lower()
        yield page[start:lt], low, attributes, closing
        start = at = end + 1
        if low in _RAW and not closing and not attributes.endswith("/"):
            shut = re.compile(rf"</{low}\s*>", re.IGNORECASE).search(page, at)
            start = at = shut.end() if shut else len(page)
    yield page[start:], "", "", False


def lines_of(page: str) -> list[Line]:
    """The blocks that are not part of a menu, advert or the like, in page order."""
    out: list[Line] = []
    text: list[str] = []
    linked, links, level = 0, 0, 0
    open_tags: list[tuple[str, bool]] = []  # nested elements that are open, and whether each begins an unwanted part
    count: Counter[str] = Counter()  # of their names
    skipping, around = 0, 0

    def end_line() -> None:
        nonlocal text, linked, level
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append(Line(joined, linked, level))
        text, linked, level = [], 0, 0

    def close_to(at: int) -> None:
        nonlocal skipping, around
        for name, unwanted in open_tags[at:]:
            skipping -= unwanted
            around -= name in _AROUND
            count[name] -= 1
        del open_tags[at:]

    for before, name, attributes, closing in tokens(page):
        if before and not skipping:
            text.append(before)
            if links:
                linked += len(before.strip())
        if not name or name in _RAW:
            continue
        if name in _BLOCKS:
            end_line()
        elif name in ("br", "img", "wbr", "td", "th") and not skipping:
            text.append(" ")
        if name == "a":
            links = not closing
        if closing:
            if count[name]:
                close_to(next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == name))
            continue
        if name in _BLOCKS and open_tags and open_tags[-1][0] in ("p", *_HEADINGS):
            close_to(len(open_tags) - 1)  # a paragraph ends where the next block begins
        while name == "body" and count["head"]:
            close_to(next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == "head"))
        if name in ("article", "main") and not count["article"] + count["main"] and skipping and around == len(open_tags):
            close_to(0)  # a part left open does not swallow the article
        if name in _HEADINGS:
            level = int(name[1])
        unwanted = _unwanted(name, attributes, open_tags[-1][0] if open_tags else "")
        if (name in _NESTED or unwanted) and name not in _VOID and not attributes.endswith("/"):
            open_tags.append((name, unwanted))
            count[name] += 1
            skipping += unwanted
            around += name in _AROUND
    end_line()
    return out


def surging(weights: np.ndarray) -> np.ndarray:
    """Which lines some window covers that sums to SURGE, or to half the page's best window if that is less."""
    sums = np.convolve(weights, np.ones(WINDOW))  # of every window that touches a line
    best = np.lib.stride_tricks.sliding_window_view(sums, WINDOW).max(axis=1)
    return best >= min(SURGE, best.max() / 2)


def main_text(page: str | None) -> str:
    """Empty for a null or empty page and where no text stands outside menus and links.

    The text runs from the first surge to the last dive.  A window also covers short lines beside the text: of these the text begins
    and ends with one that ends like a sentence (or is a heading at its start), unless more like it follow out of the windows' reach,
    as in a list.  Headings before the text are taken in, and a title a few lines up.  Lines of links in a row are left out.
    """
    lines = lines_of(page) if page else []
    weights = np.array([float(x.own) for x in lines])
    if not weights.any():
        return ""
    at = np.flatnonzero(surging(weights)).tolist()
    long = min(LONG, weights.max() / 2)
    sentence = [w >= long or w > 0 and bool(_SENTENCE.search(x.text)) for x, w in zip(lines, weights, strict=True)]
    begins = [s or w > 0 and x.level > 0 for s, x, w in zip(sentence, lines, weights, strict=True)]
    first = next((i for i in at if begins[i]), at[0])
    last = next((i for i in reversed(at) if sentence[i]), at[-1])
    short = lambda i: 0 <= i < len(lines) and sentence[i] and weights[i] < long and not lines[i].level
    if short(first) and short(first - 1):  # the end of a list of such lines, most of which no surge covers
        first = next((i for i in at if i > first and begins[i] and not short(i)), first)
    if short(last) and short(last + 1):
        last = next((i for i in reversed(at) if i < last and sentence[i] and not short(i)), last)
    while first and weights[first - 1] and lines[first - 1].level:
        first -= 1
    for i in range(first - 1, max(first - 1 - TITLE, -1), -1):
        if not weights[i] or lines[first].level == 1:
            break
        if lines[i].level == 1:
            first = i
            break
    linked = [2 * x.linked > len(x.text) for x in lines]
    kept = []
    i = first
    while i <= last:
        end = i
        while end <= last and linked[end]:
            end += 1
        if end - i >= MENU:
            i = end
            continue
        kept += lines[i : max(end, i + 1)]
        i = max(end, i + 1)
    return "\n".join(x.text for x in kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the markup, and text, n_chars (replaced where they exist).

    Row by row, no shuffle.  A null or empty page gives an empty text of 0 characters, as does one without main text; pages of any
    length are read whole, in time linear in their length; repeated rows get the same answer; an empty table gives none.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    base = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "__html"):
            texts = [main_text(h) for h in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return small_batches(base).mapInArrow(run, schema)
