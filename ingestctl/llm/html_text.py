"""Main text of web pages by composite text density.

Each page becomes a tree of its elements. An element's density is its characters per tag,
adjusted for characters and tags in links; the element whose children's densities add up
highest heads the main text. Elements beside the path from it to the body join if they are at
least as dense as the thinnest element of that path, the body included. An element marked up as
the article then takes the place of a part of it. Elements that say they are something else
(menus, forms, adverts, comments and the like) are left out before densities are taken; inside
an article, a name that says so only in part needs links or form controls as a second sign.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestctl.llm.common import code_points, whole_text

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody tfoot thead title tr ul".split()
)
CLOSES_PARAGRAPH = BLOCK - frozenset("body caption head html legend li summary tbody tfoot thead title tr".split())
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that never hold main text.
LEFT_OUT = frozenset(
    "nav footer aside form head title button select option menu dialog iframe object svg math canvas audio video "
    "label input".split()
)
#: Words in class, id or role that mark an element as something else than main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar sidebars footer masthead comment comments reply replies disqus respond cookie cookies "
    "consent notice notices alert popup modal newsletter subscribe subscription signup login share sharing social related "
    "recommended widget pagination pager skip toolbar search complementary contentinfo".split()
)
ARTICLE = frozenset(["article", "main"])
#: The marks that count on an article element itself.
ON_ARTICLE = frozenset("comment comments reply replies ad ads advert sponsored promo related".split())
#: Words that say nothing beside a mark: a name of marks and these alone is a mark as a whole.
NEUTRAL = frozenset(
    "area article articles bar block body bottom box button buttons center col column container content group inner item "
    "items left link links list main outer panel post posts right row section slot stories text top unit wrap wrapper".split()
)
#: Marks that count anywhere, whatever else a name says.
EVERYWHERE = ON_ARTICLE - {"related"}
CONTROLS = frozenset("form input select textarea button label".split())
#: The share of an element's characters in links from which a partial mark inside an article counts.
LINKED = 1 / 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|noembed|noframes|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_MARK = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Elements in page order, so that an element's descendants follow it up to its ``last``."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [0])
    last: list[int] = field(default_factory=lambda: [0])
    attributes: list[str] = field(default_factory=lambda: [""])
    out: list[bool] = field(default_factory=list)
    #: (element, text); text None: a block begins or ends here, outside any element's text
    parts: list[tuple[int, str | None]] = field(default_factory=list)


def _mark(tag: str, attributes: str) -> int:
    """0: no mark, 1: a name that is one only in part, 2: a whole one."""
    marks = ON_ARTICLE if tag == "article" else MARKS
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name in ("class", "id", "role"):
            for one in value.split():
                words = set(_MARK.findall(one))
                if not marks.isdisjoint(words):
                    found = max(found, 2 if words <= marks | NEUTRAL or not words.isdisjoint(EVERYWHERE) else 1)
    return found


def _linked_or_forms(page: Page) -> list[bool]:
    """Which elements hold form controls, or many of their characters in links."""
    n = len(page.tags)
    chars, links, controls, in_link = [0] * n, [0] * n, [tag in CONTROLS for tag in page.tags], [False] * n
    for i in range(1, n):
        in_link[i] = page.tags[i] == "a" or in_link[page.parents[i]]
    for i, text in page.parts:
        size = len("".join(text.split())) if text else 0
        chars[i] += size
        links[i] += size * in_link[i]
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        chars[up] += chars[i]
        links[up] += links[i]
        controls[up] |= controls[i]
    return [controls[i] or links[i] > LINKED * chars[i] for i in range(n)]


def _left_out(page: Page) -> list[bool]:
    """Which elements cannot hold main text: by kind, or by a mark unless an article lies inside."""
    n = len(page.tags)
    marks = [_mark(page.tags[i], a) if a and page.tags[i] not in ("html", "body", "main") else 0 for i, a in enumerate(page.attributes)]
    articles, inside = [0] * (n + 1), [False] * n  # articles: how many begin before an element
    for i, tag in enumerate(page.tags):
        articles[i + 1] = articles[i] + (tag in ARTICLE and not marks[i])
        inside[i] = tag in ARTICLE or i > 0 and inside[page.parents[i]]
    in_article = [False] * n
    for i in range(1, n):
        up = page.parents[i]
        in_article[i] = in_article[up] or page.tags[up] == "article"
    second = _linked_or_forms(page) if any(m == 1 and a for m, a in zip(marks, in_article)) else None
    out = [False] * n
    for i in range(1, n):
        kind = page.tags[i] in LEFT_OUT or page.tags[i] == "header" and not inside[i]
        wraps = articles[page.last[i] + 1] > articles[i + 1]
        marked = marks[i] == 2 or marks[i] == 1 and (not in_article[i] or second[i])
        out[i] = out[page.parents[i]] or kind or marked and not wraps
    return out


def parse(source: str) -> Page:
    """The tree of a page; end tags that may be left out and tags that are never closed are allowed for."""
    page, stack, at = Page(), [0], 0
    tags, parents, last, parts = page.tags, page.parents, page.last, page.parts
    opened: Counter = Counter()  # elements on the stack, by tag

    def close(depth: int) -> None:
        while len(stack) > depth:
            i = stack.pop()
            opened[tags[i]] -= 1
            last[i] = len(tags) - 1
            if tags[i] in BLOCK:
                parts.append((stack[-1], None))

    def close_nearest(names: set[str] | frozenset[str], stop: set[str] | frozenset[str] = frozenset()) -> None:
        if not any(opened[name] for name in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = tags[stack[depth]]
            if tag in names:
                close(depth)
                return
            if tag in stop:
                return

    for token in _TOKEN.finditer(source):
        if token.start() > at:
            parts.append((stack[-1], source[at : token.start()]))
        at = token.end()
        name = token[3] or token[6]
        if not name:
            continue
        tag, ends, attributes = name.lower(), token[2] or token[5], token[4] or token[7] or ""
        if ends:
            if tag == "br" or tag == "p" and not opened["p"]:
                parts.append((stack[-1], " " if tag == "br" else None))
            else:
                close_nearest({tag}, frozenset() if tag in BLOCK else {"td", "th", "table"})
            continue
        if tag in CLOSES_PARAGRAPH:
            close_nearest({"p"}, {"td", "th", "button", "table"})
        if tag in SAME_LEVEL:
            close_nearest(*SAME_LEVEL[tag])
        if tag in BLOCK:
            parts.append((stack[-1], None))
        elif tag in ("br", "td", "th"):
            parts.append((stack[-1], " "))
        parent = stack[-1]
        tags.append(tag)
        parents.append(parent)
        last.append(len(tags) - 1)
        page.attributes.append(attributes)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(len(tags) - 1)
            opened[tag] += 1
    if at < len(source):
        parts.append((stack[-1], source[at:]))
    close(1)
    last[0] = len(tags) - 1
    page.out = _left_out(page)
    return page


def densities(page: Page) -> list[float]:
    """The composite text density of each element; 0 for those left out."""
    n = len(page.tags)
    chars, links = [0] * n, [0] * n
    below, link_tags = [0] * n, [0] * n
    in_link = [False] * n
    for i in range(n):
        in_link[i] = page.tags[i] == "a" or (i > 0 and in_link[page.parents[i]])
    for i, text in page.parts:
        if text and not page.out[i]:
            size = len("".join(text.split()))
            chars[i] += size
            if in_link[i]:
                links[i] += size
    for i in range(n - 1, 0, -1):
        if not page.out[i]:
            up = page.parents[i]
            chars[up] += chars[i]
            links[up] += links[i]
            below[up] += below[i] + 1
            link_tags[up] += link_tags[i] + (page.tags[i] == "a")
    body = next((i for i, tag in enumerate(page.tags) if tag == "body"), 0)
    share = links[body] / max(1, chars[body])
    result = [0.0] * n
    for i in range(n):
        if not chars[i] or page.out[i]:
            continue
        tags = max(1, below[i])
        adjusted = chars[i] / max(1, links[i]) * tags / max(1, link_tags[i])
        base = math.log(chars[i] / max(1, chars[i] - links[i]) * links[i] + share * chars[i] + math.e + 1)
        result[i] = max(0.0, chars[i] / tags * math.log(adjusted) / math.log(base)) if adjusted > 1 else 0.0
    return result


def _path(page: Page, i: int) -> list[int]:
    found = [i]
    while page.tags[found[-1]] != "body" and found[-1]:
        found.append(page.parents[found[-1]])
    return found


def density_sums(page: Page, density: list[float]) -> list[float]:
    """For each element, the sum of its children's densities."""
    total = [0.0] * len(density)
    for i in range(1, len(density)):
        total[page.parents[i]] += density[i]
    return total


def dense_parts(page: Page) -> list[int]:
    """The element of the largest density sum, and those beside its path to the body that reach the path's threshold."""
    density = densities(page)
    total = density_sums(page, density)
    if not any(text and not page.out[i] and not text.isspace() for i, text in page.parts):
        return []
    best = max(range(len(total)), key=lambda i: (total[i], density[i], -i))
    path = _path(page, best)
    threshold = min(density[i] for i in path)
    on_path = set(path)
    above = on_path - {best}
    beside = [
        i
        for i in range(1, len(density))
        if page.parents[i] in above and i not in on_path and not page.out[i] and density[i] >= threshold and density[i] > 0
    ]
    return sorted([best, *beside])


def _outermost_article(page: Page) -> list[int]:
    """For each element, the outermost article around it or, outside articles, the outermost main element; -1: none."""
    n = len(page.tags)
    article, main, first = [-1] * n, [-1] * n, [-1] * n
    for i in range(n):
        up = page.parents[i]
        article[i] = article[up] if i and article[up] >= 0 else i if page.tags[i] == "article" else -1
        main[i] = main[up] if i and main[up] >= 0 else i if page.tags[i] == "main" else -1
        if article[i] == i and main[i] >= 0:
            first[main[i]] = i
    # a main element that has articles says by them which of its parts are the article
    return [article[i] if article[i] >= 0 else main[i] if main[i] >= 0 and first[main[i]] < 0 else -1 for i in range(n)]


def heads(page: Page) -> list[int]:
    """The elements that together hold the main text, in page order: the dense parts, widened to the articles around them."""
    around = _outermost_article(page)
    return sorted({around[i] if around[i] >= 0 else i for i in dense_parts(page)})


def main_text(source: str) -> str:
    """The main text: one line per block, white space inside a block being one space; empty if there is none."""
    page = parse(source)
    chosen = heads(page)
    keep = [False] * len(page.tags)
    for i in chosen:
        for j in range(i, page.last[i] + 1):
            keep[j] = not page.out[j]
    blocks, own = [], []
    for i, text in [*page.parts, (0, None)]:
        if text is None:
            line = " ".join(html.unescape("".join(own)).split())
            if line:
                blocks.append(line)
            own = []
        elif keep[i]:
            own.append(text)
    return "\n".join(blocks)


def text_column(source: Column) -> Column:
    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text).astype(object)

    return texts(source)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty page, or one without main text, has an empty text. Repeated rows come out as
    often as they go in. Other columns are ignored; an empty table gives an empty result.
    """
    return pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), text_column(whole_text(html_column)).alias("text")
    ).select("page_id", "url", "text", code_points(F.col("text")).alias("n_chars"))
