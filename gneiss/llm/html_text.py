"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block; scripts, menus and what else the markup marks as furniture goes with it. A line
weighs its characters outside links, no more than a paragraph's; being in an article or main adds a fixed weight. Weights
are summed over windows of a few lines; text between a surge of that sum over the threshold and the next dive is kept.
The added weight alone fills a window to the threshold, so unbroken text in an article stays whole, short lines included.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
#: Characters beyond so many add nothing to a line's weight, so one long line doesn't hide ordinary ones.
PARAGRAPH = 200
#: Windows under this share of the heaviest one count as a dive.
DIVE = 0.15
#: What being in an article or main adds to a line's weight: that many lines of one letter pass the greatest threshold.
SHIFT = int(DIVE * PARAGRAPH)

# HTML element names by their part in a page, and words that name furniture in class, id and role.
RAW = "script style noscript template svg math iframe object canvas head title textarea select".split()
FURNITURE = "nav header footer aside form dialog menu button".split()
INLINE = "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
HINTS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead footer sidebar side aside related recommended share social sharing comment comments commentlist disqus respond reply replies cookie "
    "cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login search widget toolbar pagination pager copyright"
).split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[/!?a-zA-Z][^>]*>",
    re.S | re.I,
)
#: Tags without regard to quotes, for pages whose quotes don't pair up.
_BARE = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>[^>]*)>|<[/!?a-zA-Z][^>]*>")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_HINTS, _FURNITURE, _INLINE, _VOID = frozenset(HINTS), frozenset(FURNITURE), frozenset(INLINE), frozenset(VOID)
# Of these words, those that a block inside an article may have and still be its text.
_SOFT = frozenset("header masthead notice notices side toolbar search widget login copyright banner".split())
_ABOUT = frozenset("with without has have no".split())  # a class such as with-sidebar is not the sidebar's
_COMMENT = frozenset("comment comments commentlist disqus respond reply replies".split())


def _hints(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    names = (set(_WORDS.findall(x)) for m in _ATTRIBUTE.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").lower().split())
    return {w for words in names if not words & _ABOUT for w in words} & _HINTS


def tokens(page: str) -> Iterator[tuple[int, int, re.Match]]:
    """Begin, end and match of each tag, comment and raw element, in time linear in the page.

    Nothing after the last ``>`` can end a tag. A tag whose quotes don't pair up reads to the end and fails; from the
    first such one on, quotes are not regarded, so that happens once.
    """
    stop, at = page.rfind(">") + 1, 0
    while m := _TOKEN.search(page, at, stop):
        if m["name"] is None and m["raw"] is None and page[m.start() + 1] not in "!?":
            for m in _BARE.finditer(page, m.start(), stop):
                yield m.start(), m.end(), m
            return
        at = m.end()
        if at == stop and (m["raw"] and not re.search(rf"</{m['raw']}\s*>\Z", m[0], re.I) or m[0].startswith("<!--") and not m[0].endswith("-->")):
            at = len(page)  # never closed
        yield m.start(), at, m
    if (rest := page.find("<!--", max(at, stop))) >= 0:
        yield rest, len(page), re.match("", "")


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters outside links, place) of each block; place is 1 inside article or main, else 0, and -1 in furniture."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    outside_links = 0
    skip, depth, hinted = "", 0, frozenset()  # the furniture element we are in, its nesting, and why
    inside = {"article": 0, "main": 0}
    in_link, at = 0, 0

    def flush() -> None:
        nonlocal parts, outside_links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                place = -1 if skip else int(inside["article"] + inside["main"] > 0)
                out.append((text, min(outside_links, len(text)), place))
        parts, outside_links = [], 0

    for begin, end, m in tokens(page):
        if begin > at:
            piece = page[at:begin]
            parts.append(piece)
            if not in_link:
                outside_links += len(piece)
        at = end
        name = (m.groupdict().get("name") or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in _INLINE:
            flush()
        if name == "a":
            in_link = 0 if m["end"] else 1
        if m["end"]:
            if skip == name:
                depth -= 1
                if depth == 0:
                    flush()
                    skip = ""
            elif not skip and name in inside and inside[name]:
                inside[name] -= 1
            continue
        hints = _hints(m["attributes"])
        if inside["article"] + inside["main"] and name not in _FURNITURE:
            hints = hints - _SOFT
        if skip:
            opens = name == "main" or name == "article" and not hints & _COMMENT and not hinted & _COMMENT
            if opens and inside["article"] == 0:
                skip = ""  # the furniture around it was never closed
            elif name == skip and name not in _VOID and name != "p":
                depth += 1
                continue
            elif skip == "p" and name not in _INLINE:
                skip = ""  # the next block ends a paragraph
            else:
                continue
        if name in inside and not hints & _COMMENT:
            inside[name] += 1
        elif name not in _VOID and (name in _FURNITURE and not (name == "header" and inside["article"]) or hints and name not in ("html", "body")):
            if name in _INLINE:
                flush()
            skip, depth, hinted = name, 1, frozenset(hints)
    parts.append(page[at:])
    if not in_link:
        outside_links += len(page) - at
    flush()
    return out


def main_text(page: str | None) -> str:
    """Blocks between surge and dive points, joined by one line feed; empty if there is none."""
    found = [x for x in lines(page or "") if x[2] >= 0]
    weights = [min(w, PARAGRAPH) + SHIFT * p for _, w, p in found]
    n = len(found)
    if not any(weights):
        return ""
    sums = [0] * n  # of this line and the next ones of the same place: text beside an article is judged by itself
    end = n
    for k in range(n - 1, -1, -1):
        if k + 1 < n and found[k + 1][2] != found[k][2]:
            end = k + 1
        sums[k] = sum(weights[k : min(end, k + WINDOW)])
    # An article is measured by its own heaviest window, what stands beside it by the page's.
    most = [max(sums), max((x for x, f in zip(sums, found) if f[2]), default=0)]
    floors = [DIVE * min(x, WINDOW * PARAGRAPH) for x in most]
    kept: list[str] = []
    k = 0
    while k < n:
        place, floor, dive = found[k][2], floors[found[k][2]], k
        if not (sums[k] > floor and weights[k]):
            k += 1
            continue
        while dive < n and found[dive][2] == place and sums[dive] > floor:  # from the surge
            dive += 1
        tail = min(n, dive + WINDOW - 1)  # the last heavy window's lines
        while dive < tail and found[dive][2] == place:
            dive += 1
        last = dive
        while not weights[last - 1]:  # links after the text
            last -= 1
        kept.extend(text for text, _, _ in found[k:last])
        k = dive
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each page; a null page counts as empty.

    Whole pages of any length, one at a time, where they are read: no shuffle, time linear in the page, and memory for
    one Arrow batch. Repeated rows give repeated rows; windows of equal weight are treated alike, so no ties arise; an
    empty table gives an empty one; other columns are left out.
    """
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
