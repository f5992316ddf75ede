"""Main text of web pages by tree scoring.

Every run of text between block-level tags is a paragraph. It passes points, one and more for length and commas, to the
containers above it, less with distance; a container's points are discounted by the share of its text that is links.
The best container, widened to the article it stands in, is kept with those siblings that score or read like it. Menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left out by tag, role and name. A name
alone doesn't decide: an element that holds most of the page's points stays, whatever it is called, if what is under no such
name has next to none and no article.

A null or empty page, or one without text, gives an empty text. Unclosed and misnested tags are closed where the next
block begins, unclosed comments and scripts run to the end. Pages that are equal get equal texts. Columns beside the id,
URL and page are not read.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>?", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody "
    "td template tfoot th thead title tr ul script style textarea iframe".split()
)
#: An open element that the start of another closes.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which the start of a block doesn't close an open one.
SCOPE = frozenset("table td th ul ol dl body html article section div".split())
DROP_TAGS = frozenset(
    "script style noscript template nav header footer aside form button select option textarea iframe object embed svg math "
    "canvas audio video dialog menu head title search label fieldset".split()
)
DROP_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
DROP_NAMES = frozenset(
    "ad ads adv adbox adslot adunit adsense advert adverts advertisement advertising sponsor sponsored promo promos promotion "
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup signin login comment comments commentlist disqus respond replies sidebar sidebars aside rail widget widgets related "
    "recommended recommendations menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead "
    "topbar toolbar share sharing social skip paywall toc".split()
)
KEPT_TAGS = frozenset("html body main article".split())
COMMENT_NAMES = frozenset("comment comments reply replies disqus".split())
CAPTIONS = frozenset(("label", "fieldset", "legend"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADER_NAMES = frozenset(("header", "masthead"))
OWN_POINTS = {"article": 25, "main": 15, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3}
#: Characters from which a paragraph counts, for a point, and points for length at most.
LEAST, POINT_CHARS, LENGTH_POINTS = 25, 100, 3
#: Share of the page's points from which an element stays in spite of its name, if the elements under no name hold less than the other.
MOST_POINTS, FEW_POINTS = 0.5, 0.2


def name_parts(value: str) -> list[str]:
    """Words of class names and ids; what follows ``no``, ``has`` or ``with`` says nothing of the element itself."""
    parts = []
    for name in value.split():
        words = [w.lower() for w in NAME_PART.findall(name)]
        parts += [w for i, w in enumerate(words) if not i or words[i - 1] not in ("no", "has", "with", "without")]
    return parts


def left_out(tag: str, attributes: str) -> str:
    """Why an element isn't part of an article: "drop", "header" (of which headings stay inside an article), either with
    "name" before it if nothing but its name says so, or ""."""
    values = {}
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            values.setdefault(name.lower(), a or b or c)
        style = values.get("style", "").replace(" ", "").lower()
        if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            return "drop"
    parts = set(name_parts(html.unescape(values.get("class", "") + " " + values.get("id", "")))) if values else set()
    if tag in KEPT_TAGS:
        return "drop" if tag == "article" and parts & COMMENT_NAMES else ""
    if tag == "header":
        return "header"
    if tag in DROP_TAGS or values.get("role", "").lower() in DROP_ROLES:
        return "drop"
    if tag in HEADINGS:
        return ""
    found = parts & DROP_NAMES
    return "" if not found else "name header" if found <= HEADER_NAMES else "drop" if found & COMMENT_NAMES else "name drop"


def worth_of(text: str) -> float:
    """Points of a paragraph."""
    return 1 + text.count(",") + min(len(text) / POINT_CHARS, LENGTH_POINTS)


class Page:
    """Elements of a page in the order of their start tags, and its paragraphs in page order."""

    def __init__(self, page: str):
        self.tag, self.parent, self.why = ["#root"], [0], [""]
        self.in_article = [False]
        self.block = [0]  # the element itself or the nearest one above it that is block-level
        self.inline_drop = [False]
        self.open: dict[str, int] = {}
        self.paragraphs: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.pieces: list[str] = []
        self.linked = 0
        stack = [0]
        links = 0
        at = 0
        while at < len(page):
            begin = page.find("<", at)
            if begin < 0:
                begin = len(page)
            if begin > at:
                self.add(stack[-1], page[at:begin], links)
            if begin == len(page):
                break
            found = TOKEN.match(page, begin)
            if not found:
                self.add(stack[-1], "<", links)
                at = begin + 1
                continue
            at = found.end()
            close, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                self.flush(stack[-1])
            if close:
                self.close(stack, tag)
                links = self.open.get("a", 0)
                continue
            if tag in VOID:
                if tag in ("br", "wbr", "hr"):
                    self.add(stack[-1], " " if tag != "wbr" else "", links)
                continue
            if tag in BLOCK:
                self.close_implied(stack, tag)
                links = self.open.get("a", 0)
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            # the labels of a form go with it, those in an article are captions
            self.why.append("" if tag in CAPTIONS and self.in_article[stack[-1]] else left_out(tag, attributes))
            self.in_article.append(self.in_article[stack[-1]] or tag in ("article", "main"))
            self.block.append(node if tag in BLOCK else self.block[stack[-1]])
            self.inline_drop.append(tag not in BLOCK and (bool(self.why[node]) or self.inline_drop[stack[-1]]))
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(page, at)
                at = end.start() if end else len(page)
            if not attributes.endswith("/"):
                stack.append(node)
                self.open[tag] = self.open.get(tag, 0) + 1
                links = self.open.get("a", 0)
        self.flush(stack[-1])

    def add(self, node: int, text: str, links: int) -> None:
        if not self.inline_drop[node]:
            self.pieces.append(html.unescape(text) if "&" in text else text)
            self.linked += len(text) if links else 0

    def flush(self, node: int) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.paragraphs.append((self.block[node], text, self.linked))
            self.pieces, self.linked = [], 0

    def cut(self, stack: list[int], at: int) -> None:
        for node in stack[at:]:
            self.open[self.tag[node]] -= 1
        del stack[at:]

    def close_implied(self, stack: list[int], tag: str) -> None:
        """Closes what the start of a block ends: an open paragraph, or an item of the same kind."""
        ends = CLOSED_BY.get(tag, frozenset())
        for i in range(len(stack) - 1, 0, -1):
            open_tag = self.tag[stack[i]]
            if open_tag == "p" or open_tag in ends:
                self.cut(stack, i)
            elif open_tag in SCOPE:
                break

    def close(self, stack: list[int], tag: str) -> None:
        if not self.open.get(tag):
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == tag:
                self.cut(stack, i)
                return
            if tag not in BLOCK and self.tag[stack[i]] in BLOCK:
                return

    def kept(self) -> list[bool]:
        """Of each element: whether no element above it is left out."""
        holds_article = [False] * len(self.tag)
        for k in range(len(self.tag) - 1, 0, -1):
            holds_article[self.parent[k]] |= holds_article[k] or self.tag[k] in ("article", "main")
        state = [""] * len(self.tag)
        stays = self.named_in_vain()
        for k in range(1, len(self.tag)):
            why = "" if k in stays else self.why[k].removeprefix("name ")
            if why == "drop" and self.tag[k] == "form" and holds_article[k]:
                why = ""
            above = state[self.parent[k]]
            if above == "drop" or why == "drop" or (why == "header" and not self.in_article[self.parent[k]]):
                state[k] = "drop"
            elif why == "header" or above == "header":
                state[k] = "header"
        return [s == "" or (s == "header" and self.tag[k] in HEADINGS) for k, s in enumerate(state)]

    def named_in_vain(self) -> set[int]:
        """Elements with a name to be left out that hold most of the points of a page without text in an article beside them."""
        shut, named = [False] * len(self.tag), [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            shut[k] = shut[self.parent[k]] or self.why[k] in ("drop", "header")
            named[k] = named[self.parent[k]] or self.why[k].startswith("name")
        points = [0.0] * len(self.tag)
        unnamed = 0.0
        for node, text, in_links in self.paragraphs:
            if not shut[node] and not named[node] and self.in_article[node]:
                return set()
            if not shut[node] and len(text) >= LEAST and self.tag[node] not in HEADINGS:
                worth = worth_of(text) * (1 - min(1.0, in_links / len(text)))
                points[node] += worth
                unnamed += 0.0 if named[node] else worth
        for k in range(len(self.tag) - 1, 0, -1):
            points[self.parent[k]] += points[k]
        if unnamed >= FEW_POINTS * points[0]:
            return set()
        return {k for k, why in enumerate(self.why) if why.startswith("name") and points[k] > MOST_POINTS * points[0]}

    def text(self) -> str:
        kept = self.kept()
        paragraphs = [p for p in self.paragraphs if kept[p[0]]]
        if not paragraphs:
            return ""
        for least in (LEAST, 1):
            best, scores = self.scored(paragraphs, least)
            if best:
                break
        above = best
        while above:
            if self.tag[above] in ("article", "main") and (self.tag[best] != "article" or self.tag[above] == "article"):
                best = above
            above = self.parent[above]
        chosen = {best} | self.siblings(best, scores, paragraphs)
        inside = [k in chosen for k in range(len(self.tag))]
        for k in range(1, len(self.tag)):
            inside[k] |= inside[self.parent[k]]
        return "\n\n".join(text for node, text, _ in paragraphs if inside[node])

    def scored(self, paragraphs: list[tuple[int, str, int]], least: int) -> tuple[int, list[float]]:
        """The best container and the points of all elements."""
        points, size, linked = ([0.0] * len(self.tag) for _ in range(3))
        has_block = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            has_block[self.parent[k]] |= self.tag[k] in BLOCK
        for node, text, in_links in paragraphs:
            size[node] += len(text)
            linked[node] += in_links
            if len(text) < least or self.tag[node] in HEADINGS:
                continue
            worth = worth_of(text)
            # text straight inside a container counts as a paragraph of it
            above, share = (node if has_block[node] else self.parent[node]), 1
            while above and share <= 3:
                if self.tag[above] in BLOCK:
                    points[above] += worth / share
                    share += 1
                above = self.parent[above]
        for k in range(len(self.tag) - 1, 0, -1):
            size[self.parent[k]] += size[k]
            linked[self.parent[k]] += linked[k]
        best = 0
        for k in range(1, len(self.tag)):
            if points[k]:
                points[k] = (points[k] + OWN_POINTS.get(self.tag[k], 0)) * (1 - min(1.0, linked[k] / max(1, size[k])))
                if not best or points[k] > points[best]:
                    best = k
        return best, points

    def siblings(self, best: int, points: list[float], paragraphs: list[tuple[int, str, int]]) -> set[int]:
        """Siblings of the best container that score near it, long or sentence-like paragraphs, and headings before it."""
        if not best or self.tag[best] in ("body", "html"):
            return set()
        own: dict[int, list[tuple[int, str, int]]] = {}
        for p in paragraphs:
            own.setdefault(p[0], []).append(p)
        found = set()
        for k in range(1, len(self.tag)):
            if self.parent[k] != self.parent[best] or k == best:
                continue
            if points[k] >= max(10, 0.2 * points[best]) or (self.tag[k] in HEADINGS and k < best):
                found.add(k)
            elif self.tag[k] == "p":
                text = " ".join(p[1] for p in own.get(k, []))
                share = sum(p[2] for p in own.get(k, [])) / max(1, len(text))
                if (len(text) > 80 and share < 0.25) or (text and share == 0 and re.search(r"[.!?](\s|$)", text)):
                    found.add(k)
        return found


def main_text(page: str | None) -> str:
    return Page(page).text() if page else ""


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(page) for page in column], dtype=object)

    read = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), texts(F.col(html_column)).alias("text")
    )
    return read.withColumn("n_chars", F.char_length("text").cast("long"))
