"""Main text of web pages by scoring the containers of the element tree.

A page is read into a flat tree (parents before children) and into blocks, the
runs of text between block-level tags.  Every block passes points for its
length and its commas, less the share of its text that is linked, to the
element that holds it and, in falling measure, to the ancestors; elements start
with points for what their tag and names promise.  The best container is
kept, raised to the article around it, with those siblings that score nearly as
well or are running text themselves.  Menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts and styles are left out by tag,
role, name or by being mostly links.

Character references are decoded, white space inside a block becomes one
space, and the blocks are joined in page order by one space.

Cases: NULL, empty or text-free pages give an empty text; a page without any
markup is its own text; unclosed and stray tags are mended as browsers do in
the common cases; deep nesting costs no recursion; repeated rows give equal rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import on_text, tables

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head caption".split())
LEFT_OUT = frozenset(
    "head nav footer aside form script style noscript template iframe button select textarea title svg math canvas object "
    "dialog menu fieldset label input datalist audio video".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote li dd dt td th figcaption caption summary address".split())
CLOSED_BY = {"p": BLOCK - {"body", "html", "head"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
             "td": frozenset(("td", "th", "tr", "tbody", "tfoot", "thead")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot", "thead")),
             "tr": frozenset(("tr", "tbody", "tfoot", "thead")), "option": frozenset(("option", "optgroup"))}
# Names of elements that are not the article, as parts of class, id or role.
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notification popup modal overlay newsletter "
    "subscribe subscription signup share sharing social related recommended recommendations comment comments disqus respond replies "
    "form search searchbox login widget toolbar pagination pager copyright contentinfo complementary dialog alert teaser teasers".split())
HEAD_NAMES = frozenset(("header", "head"))
MAIN_NAMES = frozenset("article body content entry main page post story text".split())
START = {"article": 25.0, "main": 25.0, "div": 5.0, "section": 3.0, "td": 3.0, "pre": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}
NAMED, SIBLING_SHARE, LEAST_SIBLING = 25.0, 0.2, 10.0
FAR = 64  # levels up from which on a block's points lose no more weight, and are passed on together
RUNNING_TEXT, FEW_LINKS, MOST_LINKS, MENU_LINKS = 80, 0.25, 0.5, 3


class Page:
    """Elements (parents first) and blocks of text of one page."""

    def __init__(self, html: str):
        self.tag, self.parent, self.out, self.named = ["#page"], [-1], [False], [0.0]
        self.blocks: list[list] = []  # [element, [pieces], characters in links]
        self._open, self._holders = [0], [0]  # open elements, and the block each of them stands in
        self._opened = Counter()  # open elements by name, so that looking for one that is not there costs nothing
        self._links = 0
        self._fresh = True
        at, size = 0, len(html)
        last = html.rfind(">") + 1  # no tag ends after this
        while at < size:
            found = _TAG.search(html, at, last)
            end = found.start() if found else html.find("<!--", max(at, last))
            end = size if end < 0 else end
            if end > at:
                self._text(html[at:end])
            if not found or (found[0].startswith("<!--") and not found[0].endswith("-->")):
                break
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._close(name)
                continue
            attributes = found[3] or found[6] or ""
            self._start(name, attributes)
            if name in RAW:
                closing = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = closing.end() if closing else size
                self._close(name)

    def _text(self, raw: str) -> None:
        element = self._open[-1]
        if self._fresh:
            if raw.isspace():
                return
            self.blocks.append([self._holder(), [], 0])
            self._fresh = False
        text = unescape(raw)
        if not self.out[element]:
            self.blocks[-1][1].append(text)
            if self._links:
                self.blocks[-1][2] += len(text)

    def _holder(self) -> int:
        return self._holders[-1]

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            if not self._fresh:
                self.blocks[-1][1].append(" ")
            return
        if name in BLOCK:
            self._fresh = True
            for open_, closers in CLOSED_BY.items():
                if name in closers:
                    self._close_implied(open_, name)
        if name in VOID:
            return
        above = self._open[-1]
        names = {part for found in _NAMES.findall(attributes) for part in re.split(r"[\s_-]+", "".join(found).lower())} if attributes else ()
        page_level = name in ("html", "body", "article", "main")
        inside = self._within_article()
        head = name == "header" or bool(HEAD_NAMES.intersection(names))
        out = self.out[above] or (name in LEFT_OUT) or bool(attributes and _HIDDEN.search(attributes))
        if not page_level or name == "article":
            out = out or bool(ASIDE_NAMES.intersection(names)) or (head and not page_level and not inside and name not in HEADINGS)
        self.tag.append(name)
        self.parent.append(above)
        self.out.append(out)
        self.named.append(NAMED if MAIN_NAMES.intersection(names) and not page_level else 0.0)
        self._open.append(len(self.tag) - 1)
        self._holders.append(len(self.tag) - 1 if name in BLOCK else self._holders[-1])
        self._opened[name] += 1
        if name == "a":
            self._links += 1

    def _within_article(self) -> bool:
        return self._opened["article"] > 0 or self._opened["main"] > 0

    def _close_implied(self, name: str, by: str) -> None:
        """Close an open ``name`` that the start of ``by`` ends, unless a list, table or container stands between."""
        if not self._opened[name]:
            return
        for i in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[i]]
            if tag == name:
                self._pop_to(i)
                return
            if tag in ("ul", "ol", "dl", "table", "div", "article", "section", "select", "body") or (name == "p" and tag in BLOCK):
                return

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self._fresh = True
        if not self._opened[name]:
            return
        for i in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[i]]
            if tag == name:
                self._pop_to(i)
                return
            if name not in BLOCK and tag in BLOCK:
                return

    def _pop_to(self, i: int) -> None:
        gone = [self.tag[e] for e in self._open[i:]]
        self._links -= gone.count("a")
        self._opened.subtract(gone)
        del self._open[i:], self._holders[i:]


def main_blocks(html: str | None) -> list[str]:
    """The kept blocks of a page in order."""
    if not html:
        return []
    page = Page(html)
    blocks = [(holder, " ".join("".join(pieces).split()), links) for holder, pieces, links in page.blocks]
    blocks = [(holder, text, min(links, len(text))) for holder, text, links in blocks if text]
    if not blocks:
        return []
    count = len(page.tag)
    chars, linked, links = [0] * count, [0] * count, [0] * count
    score = [START.get(tag, 0.0) + named for tag, named in zip(page.tag, page.named)]
    touched, far = [False] * count, [0.0] * count
    for holder, text, in_links in blocks:
        chars[holder] += len(text)
        linked[holder] += in_links
        points = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - in_links / len(text))
        element = page.parent[holder] if page.tag[holder] in PARAGRAPHS and holder else holder
        level = 0
        while element >= 0 and level < FAR:
            score[element] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            touched[element] = True
            element = page.parent[element]
            level += 1
        if element >= 0:
            far[element] += points
            touched[element] = True
    for element in range(count - 1, 0, -1):  # children come after their parents
        above = page.parent[element]
        if far[element]:
            score[element] += far[element] / (3 * FAR)
            far[above] += far[element]
            touched[above] = True
        chars[above] += chars[element]
        linked[above] += linked[element]
        links[above] += links[element] + (page.tag[element] == "a")
    score[0] += far[0] / (3 * FAR)
    density = [b / a if a else 0.0 for a, b in zip(chars, linked)]
    dropped = list(page.out)
    for element in range(1, count):
        menu = (page.tag[element] in ("ul", "ol", "dl", "div", "section", "table") and links[element] >= MENU_LINKS
                and density[element] > MOST_LINKS)
        dropped[element] = dropped[element] or menu or dropped[page.parent[element]]
    candidates = [e for e in range(count) if touched[e] and not dropped[e]]
    if not candidates:
        return []
    final = [s * (1 - d) for s, d in zip(score, density)]
    best = max(candidates, key=lambda e: (final[e], -e))
    for wanted in ("article", "main"):
        element = best
        while element > 0 and page.tag[element] != wanted:
            element = page.parent[element]
        if element > 0:
            best = element
            break
    kept = [False] * count
    kept[best] = True
    if best > 0:
        least = max(LEAST_SIBLING, SIBLING_SHARE * final[best])
        for element in range(1, count):
            if page.parent[element] != page.parent[best] or dropped[element] or element == best:
                continue
            kept[element] = final[element] >= least and touched[element] or (
                page.tag[element] == "p" and chars[element] >= RUNNING_TEXT and density[element] < FEW_LINKS)
    for element in range(1, count):
        kept[element] = (kept[element] or kept[page.parent[element]]) and not dropped[element]
    return [text for holder, text, _ in blocks if kept[holder] and not dropped[holder]]


def main_text(html: str | None) -> str:
    return " ".join(main_blocks(html))


def extractor(spark: SparkSession):
    """Column function: html to its main text."""
    return on_text(spark, lambda: main_text, "string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    made = pages.select("page_id", "url", extractor(pages.sparkSession)(F.col("html")).alias("text"))
    return made.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(*tables(spark, sf_dir, "pages"))
