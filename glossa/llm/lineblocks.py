"""Operator 13: main text of web pages by the distribution of text over line blocks.

1. *Strip.* Tags, comments, scripts and styles go; every block element starts a new line. Elements that are page furniture
   by name (``nav``, ``header``, ``footer``, ``aside``, ``form``, ...), role or a word of their class or id (``ad``,
   ``sidebar``, ``comments``, ``cookie``, ...) leave an empty line where they stood.
2. *Sum.* A line weighs the characters of its text outside links; the weight of a line block is the sum over ``WINDOW``
   neighbouring lines. Where the page marks an article (``article``, ``main``, or a class such as ``article-body``), lines
   outside it weigh nothing.
3. *Surge and dive.* A kept run begins where the block weight surges to the threshold and goes on until the blocks weigh
   nothing; everything between is kept, whatever its length, with the heading lines just above the surge. Inside a marked
   article any text is a surge, since its ends are marked; elsewhere the threshold is ``SURGE`` characters, or half the
   heaviest block of a page that never reaches that.

Character references are decoded once, white space within a line (``br`` included) becomes one space, lines are trimmed,
empty ones go, and the rest are joined by two line feeds.

Scale: one page at a time inside Arrow batches; no shuffle. Memory is that of one batch and of the lines of one page.

Defined cases: null, empty and text-free html give an empty text; unclosed elements end with the element around them, an
unclosed comment, script or tag at the end of the page; an article that opens inside unclosed furniture ends it;
repeated rows give repeated rows; null page_id and url are carried; an empty table gives an empty table; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86

#: Element names of HTML and words that name page furniture in its classes, ids and roles.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select button head audio video "
                "xmp noembed noframes".split())
FURNITURE = frozenset("nav header footer aside form menu dialog address".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer sidebar sidebars aside "
    "widget widgets comment comments commentlist disqus replies reply respond reader cookie cookies consent gdpr notice "
    "notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations trending popular toolbar toc copyright legal disclaimer form "
    "hidden".split())
MAIN_HINTS = frozenset("article-body articlebody article-content post-content post-body entry-content story-body main-content "
                       "page-content content-body".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
                   "nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
                    re.S)
_ATTR = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))""")
_WORD = re.compile(r"[a-z]+|[0-9]+")


def _kind(name: str, attrs: str) -> int:
    """-1 for furniture, 1 for an article's container, 0 for others."""
    if name in FURNITURE:
        return -1
    if name == "body" or name == "html":
        return 0
    kind = 1 if name in ("article", "main") else 0
    if not attrs.strip():
        return kind
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return -1
        if key == "role" and not ROLES.isdisjoint(value.split()):
            return -1
        if key == "role" and value == "main" or key == "itemprop" and value == "articlebody":
            kind = 1
        if key in ("class", "id"):
            for token in value.split():
                if token in MAIN_HINTS:
                    kind = 1
                elif kind < 1 and not HINTS.isdisjoint(_WORD.findall(token)):
                    return -1
    return kind if not re.search(r"(?i)(?:^|\s)hidden(?:\s|$)", _ATTR.sub(" ", attrs)) else -1


class Line:
    __slots__ = ("parts", "links", "inside", "heading", "gap")

    def __init__(self, inside: bool, heading: bool, gap: bool):
        self.parts: list[str] = []
        self.links: list[str] = []
        self.inside, self.heading, self.gap = inside, heading, gap


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters outside links, inside a marked article, heading) of every line of a page; furniture is one empty
    line."""
    out: list[Line] = [Line(False, False, False)]
    stack: list[tuple[str, int]] = []  # open block elements
    furniture = article = 0  # how many of them are furniture or an article's container
    link = 0
    marked = False
    at = 0

    def new_line() -> None:
        out.append(Line(article > 0 and not furniture, bool(stack) and stack[-1][0] in HEADINGS, furniture > 0))

    def pop() -> None:
        nonlocal furniture, article
        _, kind = stack.pop()
        furniture -= kind < 0
        article -= kind > 0

    def text(part: str) -> None:
        if part and not furniture:
            part = html.unescape(part)
            out[-1].parts.append(part)
            if link:
                out[-1].links.append(part)

    while True:
        token = _TOKEN.search(page, at)
        text(page[at:token.start() if token else len(page)])
        if token is None:
            break
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not token["close"] and name not in VOID and not token["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                # what can hold no text of its own ends with the page if it is never closed; a head ends at the body
                if name == "head":
                    body = re.compile(r"<body[\s>]", re.I).search(page, at)
                    at = min([m.start() for m in (end, body) if m] or [at])
                else:
                    at = end.end() if end else len(page)
                if name in ("select", "button", "object", "video", "audio"):
                    text(" ")
            continue
        if name == "a":
            link = 0 if token["close"] else 1
            continue
        if name in INLINE:
            if name == "br":
                text(" ")
            elif not token["close"] and not furniture and token["attrs"] and _kind(name, token["attrs"]) < 0:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else at
                text(" ")
            continue
        link = 0
        if token["close"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                while len(stack) > depth:
                    pop()
            new_line()
            continue
        if name in VOID:
            new_line()
            continue
        if stack and stack[-1][0] == "p" and name in ENDS_P or stack and stack[-1][0] == name and name in ("li", "option", "tr"):
            pop()
        kind = _kind(name, token["attrs"])
        if kind > 0 and name in ("article", "main") and furniture and not marked:
            while stack:  # the page's first article: the furniture before it was never closed
                pop()
        marked |= kind > 0 and not furniture
        if kind > 0 and furniture:
            kind = 0  # an article among the comments, say
        opens = kind < 0 and not furniture
        stack.append((name, kind))
        furniture += kind < 0
        article += kind > 0
        if opens or not furniture:
            new_line()
    result = []
    for line in out:
        plain = " ".join("".join(line.parts).split())
        linked = len(" ".join("".join(line.links).split()))
        if plain or line.gap:
            result.append((plain, max(0, len(plain) - linked), line.inside, line.heading))
    return result


def kept(rows: list[tuple[str, int, bool, bool]], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The texts between surge and dive points of the line-block distribution."""
    marked = any(text and inside for text, _, inside, _ in rows)
    if marked:  # lines outside the article are empty, and every line in it counts
        rows = [(text, max(chars, 1), True, head) if inside and text else ("", 0, False, False)
                for text, chars, inside, head in rows]
    weight = [chars for _, chars, _, _ in rows]
    block = [sum(weight[k:k + window]) for k in range(len(rows))]
    most = max(block, default=0)
    least = 1 if marked else surge if most >= surge else max(1, most // 2)
    out, k = [], 0
    while k < len(rows):
        if block[k] < least or not weight[k]:
            k += 1
            continue
        surged = k
        while surged and rows[surged - 1][0] and rows[surged - 1][3]:
            surged -= 1
        while k < len(rows) and block[k]:
            k += 1
        out += [text for text, chars, _, _ in rows[surged:k] if text and (marked or 2 * chars >= len(text))]
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(kept(lines(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    kinds = dict(pages.select("page_id", "url").dtypes)

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
