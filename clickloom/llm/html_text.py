"""Main text of web pages by tree scoring.

A page becomes a flat tree. Its paragraphs earn points for length and commas, less their share of link
text, and pass them to their ancestors, halved at each step. The best container, with those of its
siblings that earned enough, is the article; menus, notices, adverts, forms, comments and the like are
left out of both scoring and text. Class and id names and forms may be those of wrappers as well: they
leave out what they hold only if the best container, by points that count less below them, is elsewhere.
A name must say wholly what it names: "related-posts" does, "legal-history" is a topic. Paragraphs and
headings are left out by few names only, since their ids are anchors and their classes looks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Elements by their part in a page.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title select".split())
#: Elements in which "/>" closes; without an end tag they last until a tag of the page, as in browsers.
FOREIGN = frozenset(("svg", "math"))
FOREIGN_TAG = re.compile(r"<(/?)(svg|math)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.I)
UNQUOTED = re.compile(r"=\s*[^\s\"'=<>`]+\Z")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr input".split()
)
LEAVES = frozenset("p pre blockquote li dt dd h1 h2 h3 h4 h5 h6 td th caption figcaption address summary".split())
CLOSES_P = frozenset(
    "address article aside blockquote body center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
    "pre section table ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div body td th main".split())
APART = frozenset("nav header footer aside form button dialog menu fieldset head".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs sidebar aside widget widgets footer masthead topbar comment comments commentlist disqus discussion replies respond reply related "
    "recommended recommendations share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay pager pagination toolbar skip hidden copyright legal form search tags outbrain taboola".split()
)
#: Of these one is enough in a longer name; others may stand beside plain words only.
TELLING_NAMES = frozenset(
    "advert adverts advertisement advertising sponsored nav navbar breadcrumb breadcrumbs sidebar footer masthead topbar comments commentlist "
    "disqus newsletter gdpr pager pagination outbrain taboola".split()
)
PLAIN_WORDS = frozenset(
    "area bar block body bottom box btn button buttons card cloud column container content dark desktop div entry fb fixed form google group header "
    "icon icons inner input item items js left light link links list main middle mobile more notice outer page panel policy post posts region "
    "right row section site slot small sticky text title top twitter ui unit wide wp wrap wrapper".split()
)
PROSE = frozenset("p pre blockquote dt dd h1 h2 h3 h4 h5 h6 caption figcaption address summary".split())
PROSE_NAMES = TELLING_NAMES | {"ad", "ads", "sponsor", "copyright", "hidden"}
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BREAKS_OUT = re.compile(rf"</?(?:{'|'.join(sorted(CLOSES_P | LEAVES | INLINE - {'a'} | {'body', 'html', 'head'}, key=len, reverse=True))})\b", re.I)
CONTAINERS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SENTENCE_ENDS = (".", "!", "?", "…", "。", "！", "？", ":", ";", ".”", ".\"", ".»", ".)")
#: Elements that often wrap whole pages, and first parts of names that tell what a page has: "no-sidebar".
WRAPPERS = frozenset(("form", "fieldset"))
ABOUT = frozenset("has have no not with without".split())
#: What points count below each element that is apart by its name.
NAMED = 0.2


class Page:
    """Nodes in page order, with parents before children, and the text runs of each block."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.apart, self.named, self.look = ["#page"], [-1], [False], [False], [""]
        self.runs: list[list] = []  # block node, text pieces, link characters
        stack, at, run, in_link = [0], 0, None, 0
        opened: dict[str, int] = {}

        def text(raw: str) -> None:
            nonlocal run
            if not raw:
                return
            if run is None:
                block = next(n for n in reversed(stack) if self.tag[n] not in INLINE)
                if self.apart[stack[-1]]:
                    return
                run = [block, [], 0]
                self.runs.append(run)
            if self.apart[stack[-1]]:
                return
            piece = unescape(raw)
            run[1].append(piece)
            if in_link:
                run[2] += len(piece.strip())

        def pop_to(depth: int) -> None:
            nonlocal in_link, run
            for node in stack[depth:]:
                in_link -= self.tag[node] == "a"
                opened[self.tag[node]] -= 1
                if self.tag[node] not in INLINE:
                    run = None
            del stack[depth:]

        def close(names: set | frozenset, limits: frozenset) -> None:
            if not any(opened.get(name) for name in names):
                return
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[depth]]
                if tag in names:
                    pop_to(depth)
                    return
                if tag in limits:
                    return

        end, ends = len(html), None
        while at < end:
            less = html.find("<", at)
            if less < 0:
                text(html[at:])
                break
            match = TOKEN.match(html, less)
            if match is None:
                # A tag that the page's end cuts off is markup; any other "<" is text.
                if re.compile(r"</?[a-zA-Z]").match(html, less) and ">" not in html[less:]:
                    text(html[at:less])
                    break
                text(html[at : less + 1])
                at = less + 1
                continue
            text(html[at:less])
            at = match.end()
            tag = (match[2] or match[5] or "").lower()
            if not tag:
                continue
            if match[1] or match[4]:
                if tag == "p" or tag not in VOID:
                    close({tag}, frozenset() if tag not in INLINE else SCOPES)
                continue
            if tag in FOREIGN:
                if not _closed(match[3] or match[6] or ""):
                    ends = _foreign_ends(html) if ends is None else ends
                    if less in ends:
                        at = ends[less]
                    else:
                        out = BREAKS_OUT.search(html, at)
                        at = out.start() if out else end
                continue
            if tag in RAW:
                over = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = over.end() if over else end
                continue
            if tag == "br":
                text(" ")
                continue
            if tag in CLOSES_P:
                close(frozenset("p"), SCOPES - {"div"} if tag == "p" else SCOPES)
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], frozenset(("ul", "ol", "dl", "table")))
            attributes = match[3] or match[6] or ""
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            free = tag in ("html", "body") or not attributes
            self.apart.append(self.apart[stack[-1]] or tag in APART and tag not in WRAPPERS or not free and _apart(attributes))
            self.named.append(tag in WRAPPERS or not free and _named(tag, attributes))
            look = CLASS.search(attributes) if attributes else None
            self.look.append(" ".join(sorted("".join(filter(None, look.groups())).split())) if look else "")
            if tag not in INLINE:
                run = None
            if tag not in VOID:
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
                in_link += tag == "a"


def _closed(attributes: str) -> bool:
    """Whether a tag ends in "/>"; the "/" may also end a value without quotes."""
    return attributes.endswith("/") and not UNQUOTED.search(attributes)


def _foreign_ends(html: str) -> dict[int, int]:
    """Where svg and math elements end, by where they start, if they have an end tag."""
    opened: dict[str, list[int]] = {tag: [] for tag in FOREIGN}
    ends = {}
    for match in FOREIGN_TAG.finditer(html):
        starts = opened[match[2].lower()]
        if not match[1]:
            if not _closed(match[3]):
                starts.append(match.start())
        elif starts:
            ends[starts.pop()] = match.end()
    return ends


def _apart(attributes: str) -> bool:
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in APART_ROLES - WRAPPERS:
            return True
    return False


def _named(tag: str, attributes: str) -> bool:
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in WRAPPERS:
            return True
        if name == "class" or name == "id" and tag not in PROSE:
            for word in value.split():
                parts = [part for part in re.split(r"[^a-z]+", word) if part]
                if not parts or parts[0] in ABOUT or APART_NAMES.isdisjoint(parts):
                    continue
                if tag in PROSE and PROSE_NAMES.isdisjoint(parts):
                    continue
                if not TELLING_NAMES.isdisjoint(parts) or APART_NAMES.union(PLAIN_WORDS).issuperset(parts):
                    return True
    return False


def _scores(page: Page, blocks: list, weight: list[float]) -> tuple[list[float], list[float], list[int]]:
    """Score, link density and text size of each node, from the points of blocks times their weight."""
    n = len(page.tag)
    points, size, linked = [0.0] * n, [0] * n, [0] * n
    for node, t, links in blocks:
        size[node] += len(t)
        linked[node] += links
        earned = (1 + sum(map(t.count, ",،、，")) + min(len(t) / 100, 3)) * (1 - min(1.0, links / len(t)))
        up = page.parent[node] if page.tag[node] in LEAVES else node
        earned, least = earned * weight[node], 1e-3 * weight[node]
        while up > 0 and earned > least:
            points[up] += earned
            up, earned = page.parent[up], earned / 2
    for node in range(n - 1, 0, -1):
        size[page.parent[node]] += size[node]
        linked[page.parent[node]] += linked[node]
    density = [min(1.0, linked[k] / size[k]) if size[k] else 0.0 for k in range(n)]
    return [points[k] * (1 - density[k]) for k in range(n)], density, size


def _without_named(page: Page, blocks: list) -> list:
    """The blocks outside of named elements, unless these wrap the best container; all if none is left."""
    n = len(page.tag)
    if not any(page.named):
        return blocks
    # A page's only article or main counts in full, whatever the elements around it are named.
    held = [False] * n
    outermost = []
    for k in range(1, n):
        held[k] = held[page.parent[k]] or page.tag[k] in CONTAINERS and not page.apart[k]
        if held[k] and not held[page.parent[k]]:
            outermost.append(k)
    weight = [1.0] * n
    for k in range(1, n):
        weight[k] = weight[page.parent[k]] * (NAMED if page.named[k] else 1.0)
        if outermost == [k]:
            weight[k] = 1.0
    score, _, _ = _scores(page, blocks, weight)
    up = max(range(n), key=lambda k: (score[k], -k))
    if len(outermost) == 1 and score[outermost[0]] >= score[up] / 2:
        up = outermost[0]
    wraps = set()
    while up > 0:
        wraps.add(up)
        up = page.parent[up]
    out = [False] * n
    for k in range(1, n):
        out[k] = out[page.parent[k]] or page.named[k] and k not in wraps
    return [b for b in blocks if not out[b[0]]] or blocks


def main_text(html: str | None) -> str:
    """The article's blocks, one a line. White space inside a block is one space."""
    if not html:
        return ""
    page = Page(html)
    blocks = [(node, t, links) for node, pieces, links in page.runs if (t := " ".join("".join(pieces).split()))]
    blocks = _without_named(page, blocks)
    if not blocks:
        return ""
    n = len(page.tag)
    score, density, size = _scores(page, blocks, [1.0] * n)
    best = max(range(n), key=lambda k: (score[k], -k))
    # A container that names itself the article holds all of it.
    up = best
    while up > 0:
        if page.tag[up] in CONTAINERS:
            best = up
        up = page.parent[up]
    above = page.parent[best]
    beside = [k for k in range(1, n) if page.parent[k] == above and above >= 0]
    chosen = {best} | {k for k in beside if score[k] >= max(0.2 * score[best], 2) and density[k] < 0.3}
    if best == 0:
        chosen = {0}
    holds_itself = page.tag[best] in CONTAINERS
    if not holds_itself and above >= 0:
        # Siblings that look like the container, or lie between chosen ones, are its parts however short.
        parts = [k for k in beside if score[k] > 0 and density[k] < 0.3]
        chosen |= {k for k in parts if (page.tag[k], page.look[k]) == (page.tag[best], page.look[best])}
        first, last = min(chosen), max(chosen)
        chosen |= {k for k in parts if first < k < last}
    if above >= 0:  # paragraphs beside the container
        chosen |= {
            node for node, t, links in blocks
            if page.parent[node] == above and page.tag[node] in LEAVES
            and (len(t) > 80 and links < 0.25 * len(t) or not holds_itself and not links and t.endswith(SENTENCE_ENDS))
        }
    within = [False] * n
    for k in range(n):
        within[k] = k in chosen or k > 0 and within[page.parent[k]]
    # A list of links ahead of the first prose is a menu without a name; below prose it lists sources.
    prose = min((node for node, t, links in blocks if within[node] and page.tag[node] not in HEADINGS and 4 * links < len(t) and len(t) > 25), default=n)
    inside, has_menus, in_article = [False] * n, page.tag.count("a") > 2, [False] * n
    for k in range(n):
        in_article[k] = page.tag[k] == "article" or k > 0 and in_article[page.parent[k]]
        inside[k] = k in chosen or k > 0 and inside[page.parent[k]]
        menu = k < prose and page.tag[k] in ("ul", "ol", "div", "table") and density[k] > 0.8 and size[k] > 0 and has_menus
        if k not in chosen and menu and not in_article[k]:
            inside[k] = False
    return "\n".join(t for node, t, _ in blocks if inside[node])


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``, from the whole html.

    Null and empty html, and pages without text, give an empty text. Null ids and urls and repeated rows
    stay as they are; other columns are not read. Unclosed and stray tags, attributes and cut-off ends are
    read as browsers would, as far as the tree of blocks goes. Of equal scores the first container wins.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(pages[id].cast("long").alias("page_id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
