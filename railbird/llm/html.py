"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block.  What the markup itself says is a menu, header, footer,
sidebar, form or hidden is stripped with it and leaves empty lines.  A line's length is that of its text
outside links.  Lengths are summed over a sliding window of lines: a run of lines starts where the sum rises
from nothing and ends where it dives to nothing, and is text if the sum surges inside it; on a page whose sums are
all low, its highest run is the text.

Names of classes and ids drop nothing.  Blocks that bear a name of notices, adverts, comments and the like are taken out of the lines around them and
weighed by themselves: their lines count for a part of their length, less outside an article, and they are text where the sum still surges.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.stage import bound_batches, typed

WINDOW = 3  # lines in a sum
SURGE = 86  # characters in a window that make a surge
WEIGHT_INSIDE, WEIGHT_OUTSIDE, WEIGHT_NAMED = 0.75, 0.25, 0.02  # what a character counts in a suspect block: in an article, elsewhere, and where a name says nothing else
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ARTICLE_ROLE = re.compile(r"""role\s*=\s*["']?(?:main|article)""", re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text; of the first ones a missing end means the end of the page, of the others that there is no content.
_RAW_TO_END = frozenset("script style textarea title xmp noembed noframes".split())
_RAW = _RAW_TO_END | frozenset("noscript template iframe svg object canvas select option button".split())
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*+>?", re.I | re.A) for t in _RAW}
#: Stands inside a text as well as beside it: cuts no run.
_ASIDES = frozenset("aside form dialog".split())
_BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Parts of class names and ids, between hyphens, underscores and spaces, that make a block suspect.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promotion promoted recommended related reply replies respond share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_CLOSES_P = _BLOCKS - {"br", "body", "html", "head"}


#: Of these, words that articles have in names of their own.
_COMMON = frozenset("comment copyright disclaimer header notice notices recommended related replies reply share sharing social widget widgets".split())


def _is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether markup says that an element isn't text: by its tag, role or being hidden."""
    if tag in _BOILERPLATE or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *value in _ATTRIBUTE.findall(attributes):
        name, text = name.lower(), "".join(value)
        if name == "role" and text.lower() in _ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and text.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", text, re.I):
            return True
    return False


def _weight(tag: str, attributes: str, in_article: bool) -> float:
    """What a character inside the element counts, by the names that it bears."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return 1
    known = _WORDS - ({"header"} if in_article else set())
    out = 1.0
    for name, *value in _ATTRIBUTE.findall(attributes):
        if name.lower() not in ("class", "id"):
            continue
        for token in "".join(value).split():
            parts = {p for p in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if p}
            if parts and parts <= known and parts - _COMMON:
                return WEIGHT_NAMED
            if parts & known:
                out = WEIGHT_INSIDE if in_article else WEIGHT_OUTSIDE
    return out


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, weighed length outside links, suspect block or 0) per block, in page order; empty lines for what isn't text.

    A line of links alone is 0 long, inside an article 1.  Each character is visited a
    bounded number of times, whatever the markup: once a quote in a tag has no end, tags end
    at the next ``>``; a tag without any takes the rest of the page, as in browsers.
    """
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, boilerplate, article, suspect
    open_ = Counter()
    endless: set[str] = set()
    dropping = articles = links = plain = suspects = block = 0
    quotes_end, weight = True, 1.0

    def text(a: int, b: int) -> None:
        nonlocal plain
        if a < b and not dropping:
            t = entities.unescape(page[a:b])
            parts.append(t)
            if not links:
                plain += len("".join(t.split()))

    def flush() -> None:
        nonlocal plain
        if parts:
            t = " ".join("".join(parts).split())
            if t:
                out.append((t, int(plain * weight) if suspects else plain or int(articles > 0), block if suspects else 0))
            parts.clear()
        plain = 0

    def gap(tag: str) -> None:
        flush()
        if not (tag in _ASIDES or articles):
            out.extend([("", 0, block if suspects else 0)] * WINDOW)
        elif out and out[-1][0]:
            out.append(("", 0, block if suspects else 0))

    def pop() -> None:
        nonlocal dropping, articles, links, suspects
        tag, bad, article, suspect = stack.pop()
        open_[tag] -= 1
        if tag in _BLOCKS:
            flush()
        articles -= article
        if bad:
            dropping -= 1
            if not dropping:
                gap(tag)
        if suspect:
            flush()
            suspects -= 1
            if not suspects and not dropping:
                gap(tag)
        links -= tag == "a"

    at, last = 0, page.rfind(">")
    while m := _OPEN.search(page, at):
        text(at, m.start())
        name = m[2]
        if not name:
            end = page.find("-->" if m[0] == "<!--" else ">", m.end())
            at = len(page) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        if last < m.end():
            at = len(page)
            break
        tag, closes = name.lower(), bool(m[1])
        whole = _QUOTED.match(page, m.end()) if quotes_end and not closes else None
        quotes_end = quotes_end and (closes or whole is not None)
        at = whole.end() if whole else page.find(">", m.end()) + 1
        if closes:
            if tag in _BLOCKS:
                flush()
            if open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        attributes = page[m.end() : at - 1]
        if tag in _RAW and not attributes.endswith("/"):
            close = None if tag in endless else _ENDS[tag].search(page, at)
            if close:
                at = close.end()
            elif tag in _RAW_TO_END:
                at = len(page)
            else:
                endless.add(tag)
            continue
        if tag in _BLOCKS:
            flush()
            if tag in _CLOSES_P and any(t[0] == "p" for t in stack[-3:]):
                while stack and stack[-1][0] not in ("p", "article", "main", "section", "div", "body", "td", "li", "blockquote"):
                    pop()
                if stack and stack[-1][0] == "p":
                    pop()
        if tag in _VOID or attributes.endswith("/"):
            continue
        article = tag in ("article", "main") or bool(attributes and _ARTICLE_ROLE.search(attributes))
        bad = _is_boilerplate(tag, attributes, articles > 0)
        if bad and not dropping:
            gap(tag)
        own = 1 if bad or dropping else _weight(tag, attributes, articles > 0)
        if own < 1:
            if not suspects:
                gap(tag)
                block, weight = block + 1, own
            flush()
            suspects += 1
        stack.append((tag, bad, article, own < 1))
        open_[tag] += 1
        dropping += bad
        articles += article
        links += tag == "a"
    text(at, len(page))
    flush()
    return out


def text_runs(lengths: list[int], window: int = WINDOW, surge: int = SURGE, highest: bool = True) -> list[tuple[int, int]]:
    """[first, end) of the runs of lines that are text: from a rise to a dive, with a surge between; with ``highest`` the highest sum is a surge in any case."""
    sums, total = [0] * len(lengths), 0
    for i in range(len(lengths) - 1, -1, -1):
        total += lengths[i] - (lengths[i + window] if i + window < len(lengths) else 0)
        sums[i] = total
    least = min(surge, max(sums, default=0)) if highest else surge
    runs, i = [], 0
    while i < len(sums):
        j = i
        while j < len(sums) and sums[j]:
            j += 1
        if j > i:
            if max(sums[i:j]) >= least:
                while not lengths[i]:  # the window looks ahead: it rises before the first line that has a length
                    i += 1
                end = j
                while not lengths[end - 1]:
                    end -= 1
                runs.append((i, end))
            i = j
        else:
            i += 1
    return runs


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The blocks between surges and dives, in page order, joined by a space; suspect blocks by their own sums."""
    found = lines(page or "")
    blocks: dict[int, list[int]] = {0: []}
    for i, (_, _, block) in enumerate(found):
        blocks.setdefault(block, []).append(i)
    kept = []
    for block, at in blocks.items():
        for a, b in text_runs([found[i][1] for i in at], window, surge, highest=block == 0):
            kept += at[a:b]
    return " ".join(found[i][0] for i in sorted(kept) if found[i][0])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every row, with text and n_chars (its code points).

    Null or empty html, and pages without text, give an empty text.  Whole pages are read,
    very long ones too, in time in proportion to their length; Arrow batches end by bytes.
    Repeated rows and ties each return a row; other columns are left out, so none can clash;
    an empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"]
            )

    return pages.select(*keep, F.col(html_col).cast("string").alias("_html")).mapInArrow(run, f"{typed(pages, *keep)}, text string, n_chars long")
