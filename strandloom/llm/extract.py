"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to the elements around them, less to farther
ones; an element's points are discounted by the share of its text inside links.  The element with
the most points is the container.  It grows to the article it lies in, or else takes the
neighbours that read like text.  Parts that are not text by their tag or role are left out.  Names
lower the points of what is inside; such parts are left out unless the container lies in them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<odd_end>/?)(?P<odd>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start a line of their own.
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td
    tfoot th thead tr ul""".split())
#: An open element of these is ended by the start of those.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
          "option": {"select"}}
_NEVER = frozenset("""aside audio button canvas datalist dialog footer form head iframe map menu nav noscript object select svg
    template video""".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words that name parts around the text, in a class or id that has no others than those of _FILL besides.
_PARTS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments
    consent cookie cookies disclaimer disqus footer form gdpr header hidden login masthead menu menus modal nav navbar navigation
    newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond
    search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets""".split())
_FILL = frozenset("""area bar block bottom box btn button container group inner item items left list main outer panel right section site
    slot text top unit wrap wrapper""".split())
#: Words that name such a part by standing first or last in a token, whatever the others say.
_SURE = frozenset("""ad ads adsbygoogle adsense adslot adunit advert advertisement advertisements advertising adverts bio breadcrumb
    breadcrumbs comment commenting commentlist comments consent cookie cookies discussion disqus gdpr googleads newsletter pager
    pagination promo promos promoted promotion recommendation recommendations recommended related replies respond responses signup
    sponsor sponsored sponsors subscribe subscription""".split())
#: Words after which another one says what a page has, lacks or is about.
_NEUTRAL = frozenset("category enabled format free has hide is no non not open overflow show status tag tagged topic type with without".split())
#: Words that only together name a part around the text.
_PHRASE = re.compile(r"(?:about-(?:the-)?|post-|entry-)?author-(?:bio|box|card|info|profile)|about-(?:the-)?author|more-(?:articles|from|like|news|posts|reading|stories)"
                     r"|most-(?:popular|read|viewed)|read-(?:more|next)|you-(?:may|might)|trending")
#: Share of links in a box from which it is a menu, and how many of them it then has at least.
LINKED, MENU = 0.9, 2
#: Share of its points that text keeps inside a part with such a name.
LOWERED = 0.2
_TAG_POINTS = {"article": 8, "main": 8, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3,
               "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}
LEAST = 25
_BOXES = frozenset("div dl ol section table ul".split())


def _names_part(token: str) -> bool:
    """Whether a class or id names a part around the text."""
    words = [w.lower() for w in _NAME.findall(token)]
    if not words:
        return False
    if not _PARTS.isdisjoint(words) and _PARTS.union(_FILL).issuperset(words):
        return True
    if not _NEUTRAL.isdisjoint(words):
        return False
    return words[0] in _SURE or words[-1] in _SURE or _PHRASE.match("-".join(words)) is not None


class _Page:
    """Elements of a page in order, and its lines of text with the element each stands in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.last, self.part, self.unlikely = ["html"], [-1], [0], [False], [False]  # last: the last element inside
        self.lines: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self.open, self.links = [0], 0
        self.pieces: list[tuple[str, bool]] = []
        for token in _TOKEN.finditer(source):
            if token["text"] is not None:
                self.pieces.append((token["text"], self.links > 0))
            elif name := (token["tag"] or token["odd"] or "").lower():
                if token["end"] or token["odd_end"]:
                    self.close(name)
                else:
                    self.start(name, token["attrs"] or "")
        while self.open:
            self.pop()

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(t for t, _ in self.pieces)).split())
            if text:
                linked = sum(len(" ".join(t.split())) for t, inside in self.pieces if inside)
                self.lines.append((self.open[-1] if self.tag[self.open[-1]] in _BLOCK else self.block(), text, min(linked, len(text))))
            self.pieces = []

    def block(self) -> int:
        return next((e for e in reversed(self.open) if self.tag[e] in _BLOCK), 0)

    def pop(self) -> None:
        e = self.open[-1]
        if self.tag[e] in _BLOCK:
            self.flush()
        self.links -= self.tag[e] == "a"
        self.last[e] = len(self.tag) - 1
        self.open.pop()

    def close(self, name: str) -> None:
        if name == "p" and not any(self.tag[e] == "p" for e in self.open):
            self.flush()
            return
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.tag[self.open[i]] == name), None)
        if at is None or name in ("html", "body"):
            return
        if name not in _BLOCK and any(self.tag[e] in _BLOCK for e in self.open[at + 1:]):
            return  # a stray end of inline markup does not end blocks
        while len(self.open) > at:
            self.pop()

    def start(self, name: str, attrs: str) -> None:
        if name == "br":
            self.pieces.append((" ", False))
            return
        if name in _BLOCK:
            self.flush()
            if any(self.tag[e] == "p" for e in self.open):
                while self.tag[self.open[-1]] != "p":
                    self.pop()
                self.pop()
        if name in _ENDS:
            for i in range(len(self.open) - 1, 0, -1):
                tag = self.tag[self.open[i]]
                if tag in _SCOPE[name]:
                    break
                if tag in _ENDS[name]:
                    while len(self.open) > i:
                        self.pop()
                    break
        if name in _VOID or name in ("html", "body"):
            return
        self.tag.append(name)
        self.parent.append(self.open[-1])
        self.last.append(len(self.tag) - 1)
        part, unlikely = self.named(attrs) if attrs and not attrs.isspace() else (False, False)
        self.part.append(name in _NEVER or part)
        self.unlikely.append(unlikely)
        if name == "header":  # a page's header, not that of an article
            self.part[-1] |= not any(self.tag[e] in ("article", "main") for e in self.open)
        self.open.append(len(self.tag) - 1)
        self.links += name == "a"

    @staticmethod
    def named(attrs: str) -> tuple[bool, bool]:
        """Whether the element is no text by its role or style, and whether its class or id names a part."""
        unlikely = False
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                unlikely |= any(map(_names_part, value.split()))
            value = value.lower()
            if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True, unlikely
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, unlikely
        return False, unlikely


def main_text(source: str) -> str:
    """The page's main text, one line for each block; empty if there is none."""
    page = _Page(source)
    n = len(page.tag)
    size = [0] * n
    for e, text, _ in page.lines:
        size[e] += len(text)
    for e in range(n - 1, 0, -1):
        size[page.parent[e]] += size[e]
    # what is named like a part but holds an article, or nearly all of the page, is a wrapper
    holds = [t in ("article", "main") for t in page.tag]
    for e in range(n - 1, 0, -1):
        holds[page.parent[e]] |= holds[e]
    out, inside = [False] * n, [0] * n  # inside: the innermost part by name that an element lies in
    for e in range(1, n):
        wrapper = page.tag[e] not in _NEVER and page.tag[e] not in ("article", "main") and (holds[e] or 10 * size[e] > 9 * size[0])
        out[e] = page.part[e] and not wrapper or out[page.parent[e]]
        inside[e] = e if page.unlikely[e] and not wrapper else inside[page.parent[e]]
    lines = [(e, text, linked) for e, text, linked in page.lines if not out[e]]
    size, linked_size, points = [0] * n, [0] * n, [0.0] * n
    given = set()
    for e, text, linked in lines:
        size[e] += len(text)
        linked_size[e] += linked
        if len(text) >= LEAST and not page.tag[e].startswith("h"):
            value = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)
            value *= LOWERED if inside[e] else 1
            above, level = (page.parent[e] if page.tag[e] in ("p", "pre", "li", "td", "blockquote") else e), 0
            while above >= 0 and level < 5:
                if above not in given:
                    given.add(above)
                    points[above] += _TAG_POINTS.get(page.tag[above], 0) * (LOWERED if inside[above] else 1)
                points[above] += value / (1, 2, 6, 9, 12)[level]
                if inside[above] == above:
                    break  # parts give nothing to what is around them
                above, level = page.parent[above], level + 1
    for e in range(n - 1, 0, -1):
        if inside[e] != e:
            size[page.parent[e]] += size[e]
            linked_size[page.parent[e]] += linked_size[e]
    density = [b / a if a else 0.0 for a, b in zip(size, linked_size, strict=True)]
    score = [p * (1 - d) for p, d in zip(points, density, strict=True)]
    scored = [e for e in given if not out[e]]
    best = min(scored, key=lambda e: (-score[e], e), default=None)
    if best is None or inside[best]:  # nothing long enough: the article or main part, else all that is left
        best = next((e for t in ("article", "main") for e in range(n) if page.tag[e] == t and size[e] and not inside[e]), best or 0)
    above = best
    while above > 0 and page.tag[above] not in ("article", "main"):
        above = page.parent[above]
    chosen = [(best, page.last[best])]
    if above > 0:
        chosen = [(above, page.last[above])]
    elif best > 0:
        least = max(10.0, 0.2 * score[best])
        for e in range(1, n):
            if page.parent[e] == page.parent[best] and e != best and not out[e] and (inside[best] or not inside[e]):
                heading = len(page.tag[e]) == 2 and page.tag[e][0] == "h" and page.tag[e][1].isdigit()
                prose = page.tag[e] == "p" and (density[e] < 0.25 and size[e] > 80 or density[e] == 0 and size[e] > 0)
                if score[e] >= least or heading or prose:
                    chosen.append((e, page.last[e]))
    around = {a for a, _ in chosen}  # parts that the text lies in
    for a, _ in chosen:
        while (a := page.parent[a]) > 0:
            around.add(a)
    around.add(0)
    # boxes of nothing but links inside the text are menus, too
    links = [0] * n
    for e, _, linked in lines:
        links[e] += linked > 0
    whole, whole_linked = [0] * n, [0] * n
    for e, text, linked in lines:
        whole[e] += len(text)
        whole_linked[e] += linked
    for e in range(n - 1, 0, -1):
        for total in (links, whole, whole_linked):
            total[page.parent[e]] += total[e]
    menu = [False] * n
    for e in range(1, n):
        box = page.tag[e] in _BOXES and e not in around and links[e] >= MENU and whole_linked[e] >= LINKED * whole[e]
        menu[e] = box or menu[page.parent[e]]
    return "\n".join(text for e, text, _ in lines
                     if inside[e] in around and not menu[e] and any(a <= e <= b for a, b in chosen))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h or "") for h in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty page, and one without text, gives an empty text.  Repeated rows and null ids
    give a row each, an empty table none; other columns are ignored.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
