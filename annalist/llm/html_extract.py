"""Main text of web pages by line-block distribution.

Markup is cut into blocks (lines) where block-level elements begin or end; scripts, styles and comments
vanish, and so do navigation, headers, footers, sidebars, forms, adverts and readers' comments, told by element, role or
class.  The distribution is that of text lengths summed over a sliding window of WINDOW lines.  At a surge, where a sum
rises over the threshold (SURGE characters, or SHARE of the page's highest sum if that is less), the main text begins;
at the next dive, where the sum falls to nothing, it ends; lines between the two are kept.  What a page says about its lines
weighs their lengths:

  links      text in links has no length; in a marked article LINKED of it
  article    where a page marks its article, other lines have no length, and a surge reaches back to the dive before it
             (a title and a by-line are short)
  doubtful   blocks whose class may stand for either (DOUBTFUL: legal, related, popular, ...) are a distribution of
             their own: prose that surges over SURGE is kept, short lines and links aren't

Defined results: a null or empty page gives an empty text; character references are decoded (also those
without a semicolon, as browsers do); white space inside a block becomes one space; blocks are
joined by a line feed in page order; a head that isn't closed ends where something else than head content begins; repeated rows are extracted row by row; other columns are ignored.
Each page is one row's work: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, SURGE, SHARE, LINKED = 3, 80, 0.25, 0.3

#: Element names of HTML.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas select datalist audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("head nav footer aside form button dialog menu search fieldset label".split()) | RAW
CLOSES_P = BLOCK - {"br", "body", "html", "option", "optgroup"}
HEAD = frozenset("base head html link meta noframes noscript script style template title".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_DROP_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|breadcrumbs?|nav\w*|menu\w*|sidebar\w*|side-?bar|footer\w*|cookies?\w*|consent|gdpr|notices?|newsletter\w*|subscri\w*|signup|login|popup|modal|overlay"
    r"|comments?|commentlist|comment-?\w+|disqus\w*|replies|reply|respond|pagination|pager|toolbar|skip-?link|masthead|site-?header|page-?header|topbar)(?:$|[\s_-])",
    re.I,
)
#: Names that stand for boilerplate or for parts of an article.
DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:social\w*|share|sharing|related\w*|recommend\w*|widget\w*|copyright|legal|disclaimer|trending|popular|tags?|tag-?list|toc)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"[\s\x00]+")


class Line:
    __slots__ = ("article", "boiler", "doubtful", "linked", "parts")

    def __init__(self):
        self.parts, self.linked, self.boiler, self.article, self.doubtful = [], 0, False, False, False


def _is_boiler(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROP:
        return True
    if name == "header" and not in_article:
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in DROP_ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true" and name not in ("article", "main", "body", "html")):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id") and name not in ("article", "main", "body", "html") and _DROP_NAME.search(value):
            return True
    return False


def _is_doubtful(name: str, attributes: str) -> bool:
    return name not in ("article", "main", "body", "html") and any(m[1].lower() in ("class", "id") and DOUBTFUL.search(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes))


def lines(html: str) -> list[Line]:
    """Blocks of a page in order, with what stands around each."""
    out: list[Line] = []
    stack: list[list] = []  # name, drops, is an article, is a link, is doubtful
    line, dropping, articles, links, doubts, at = Line(), 0, 0, 0, 0, 0

    def cut():
        nonlocal line
        if line.parts:
            out.append(line)
        line = Line()

    def text(s: str):
        if s:
            if stack and stack[-1][0] == "head" and s.strip():
                pop()
            line.parts.append(s)
            if links:
                line.linked += len(s)
            line.boiler = dropping > 0
            line.article = articles > 0
            line.doubtful = doubts > 0

    def pop():
        nonlocal dropping, articles, links, doubts
        name, drops, article, link, doubtful = stack.pop()
        if name in BLOCK or drops or doubtful:
            cut()
        dropping, articles, links, doubts = dropping - drops, articles - article, links - link, doubts - doubtful

    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        text(html[at : m.start()])
        at = m.end()
        end, name, attributes = m[1], m[2], m[3]
        if end:
            end = end.lower()
            if end in BLOCK:
                cut()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == end:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("article", "main", "body", "td", "table") and end not in BLOCK:
                    break
        elif name:
            name = name.lower()
            if name in BLOCK:
                cut()
            if stack and stack[-1][0] == "head" and name not in HEAD:
                pop()
            if name in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in BLOCK:
                        if stack[k][0] == "p" or (stack[k][0] == name == "li") or (name in ("dt", "dd") and stack[k][0] in ("dt", "dd")):
                            while len(stack) > k:
                                pop()
                        break
            if name in VOID or attributes.rstrip().endswith("/"):
                continue
            drops = _is_boiler(name, attributes, articles > 0)
            doubtful = not drops and _is_doubtful(name, attributes)
            if drops or doubtful:
                cut()
            article = name == "article" or name == "main"
            stack.append([name, int(drops), int(article), int(name == "a"), int(doubtful)])
            dropping, articles, links, doubts = dropping + drops, articles + article, links + (name == "a"), doubts + doubtful
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else len(html)
                pop()
    text(html[at:])
    cut()
    return out


def between(lengths: list[float], window: int, threshold: float, foot: bool = False) -> list[bool]:
    """Which lines stand between a surge over the threshold and the next dive; with foot, from the dive before the surge on."""
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    kept, i = [False] * n, 0
    while i < n:
        if sums[i] > threshold and lengths[i]:  # the surge
            j = i
            while foot and j and not kept[j - 1] and sums[j - 1]:
                j -= 1
            while i < n and sums[i]:  # up to the dive
                i += 1
            kept[j:i] = [True] * (i - j)
        else:
            i += 1
    return kept


def extract(html: str, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> str:
    found = []
    for x in lines(html):
        if not x.boiler:
            s = _SPACE.sub(" ", unescape("".join(x.parts))).strip()
            if s:
                found.append((s, x))
    marked = any(x.article for _, x in found)
    if marked:
        found = [(s, x) for s, x in found if x.article]
    linked = LINKED if marked else 0.0
    plain = [max(0.0, len(s) - (1 - linked) * x.linked) if marked or 2 * x.linked <= len(s) else 0.0 for s, x in found]
    # the lines that aren't in doubt
    sure = [i for i, (_, x) in enumerate(found) if not x.doubtful]
    lengths = [plain[i] for i in sure]
    peak = max((sum(lengths[i : i + window]) for i in range(len(lengths))), default=0.0)
    kept = {i for i, k in zip(sure, between(lengths, window, min(surge, share * peak), marked), strict=True) if k}
    # each run of doubtful lines
    i = 0
    while i < len(found):
        j = i
        while j < len(found) and found[j][1].doubtful:
            j += 1
        own = [max(0, len(s) - x.linked) if 2 * x.linked <= len(s) else 0 for s, x in found[i:j]]
        kept.update(i + k for k, y in enumerate(between(own, window, surge)) if y)
        i = max(j, i + 1)
    return "\n".join(found[i][0] for i in sorted(kept))


def extract_pages(pages: DataFrame, html: str = "html", columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """columns, text and n_chars (code points) of every page."""
    C.bounded_batches(pages.sparkSession)
    kept = pages.select(*(C.column(c) for c in columns), F.coalesce(C.column(html).cast("string"), F.lit("")).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_html") + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(h) for h in b.column("_html").to_pylist()]
            own = [n for n in b.schema.names if n != "_html"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in own), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], names=[*own, "text", "n_chars"])

    return kept.mapInArrow(C.tidy(run), schema)
