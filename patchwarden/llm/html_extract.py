"""Main-text extraction from HTML by tree scoring.

A tolerant tokenizer builds the element tree. Elements that cannot hold article text (scripts, menus,
adverts by element or role, hidden ones) are left out while it is read. Every text block passes points for its
length and commas to its ancestors, halved at each step, in one sweep from the leaves to the root; a
container's points are discounted by its link density. The best container and those siblings that score
or read like it are kept, and its blocks are written in page order, one a line, whole.

Class and id names weigh: good ones add points. A container named as a part of the page
(notice, advert, comments, ...), and a form, is left out only beside other text: one that holds most
of the page's unlinked text is judged by its points like any other, whatever it is called, and so are
comments if there is nothing else.

Defined results: null, empty or text-free html gives an empty text; rows are extracted one by one, so
repeated rows give repeated results; an empty table gives an empty result; columns other than
page_id, url and html are not read. Work is linear in a page's length, however deep it is nested.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|"""
    r"""<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "svg", "math", "template", "noscript", "object", "canvas", "video", "audio", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "nobr", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br",
}
_DROP = {"nav", "aside", "footer", "header", "button", "menu", "dialog", "fieldset", "input", "head", "label"} | _RAW
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
_LISTS = ("ul", "ol", "dl", "table", "select")
_SCOPE = {"table", "ul", "ol", "dl", "td", "th", "body", "html", "article", "section", "main", "blockquote"}
_BAD_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "notification", "alert", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer",
    "header", "masthead", "comment", "comments", "commentlist", "reply", "replies", "disqus", "respond", "social", "share", "sharing", "related",
    "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "widget", "toolbar", "pagination",
    "pager", "copyright", "legal", "disclaimer", "hidden", "paywall", "outbrain", "taboola", "toc", "skip", "search", "trending", "popular",
}
#: words that say nothing of what a part holds: "site-footer-left" is a footer, "legal-history" no legal notice
_LAYOUT_WORDS = {
    "site", "page", "main", "top", "bottom", "left", "right", "center", "primary", "secondary", "container", "content", "wrapper", "wrap", "box", "area", "list", "item", "items",
    "section", "block", "blocks", "inner", "outer", "row", "col", "column", "columns", "grid", "bar", "links", "link", "buttons", "button", "icons", "icon", "form", "slot", "panel",
    "holder", "module", "component", "trail", "thread", "feed", "post", "posts", "entry", "article", "articles", "stories", "blog", "body", "reader", "user", "js", "sticky", "visually",
}
#: elements that hold parts of a page and are judged by their names
_CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "tr", "td", "center", "figure", "details"}
_AD_WORDS = {"ad", "ads", "advert", "hidden", "sponsored"}
_BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tooltip", "status"}
_COMMENT_WORDS = {"comment", "comments", "commentlist", "reply", "replies", "disqus", "respond"}
_GOOD_WORDS = {"article", "content", "entry", "hentry", "main", "post", "story", "text", "body", "blog", "prose", "page"}
_CONTENT = {"article", "main", "body", "html"}
#: text of these counts for their parent, which is the container
_TEXT = {"p", "pre", "td", "h1", "h2", "h3"}
#: short texts of these count as well
_POINTS = {"p", "h1", "h2", "h3", "li", "blockquote", "pre"}
#: a named part goes if at least this share of its unlinked text stands elsewhere
BESIDE = 0.5
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


KEEP, DROP, PART, COMMENTS = range(4)


class _Node:
    __slots__ = ("tag", "parent", "weight", "index", "good", "part", "points", "score", "chars", "link_chars")

    def __init__(self, tag, parent, weight, index, good, part):
        self.tag, self.parent, self.weight, self.index, self.good, self.part = tag, parent, weight, index, good, part
        self.points = self.score = 0.0
        self.chars = self.link_chars = 0


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for k, v in _ATTR.findall(text):
        v = v[1:-1] if v[:1] in "\"'" and len(v) > 1 else v
        out.setdefault(k.lower(), v)
    return out


def _bad_name(name: str, bad: set[str]) -> bool:
    """Whether a class or id has a bad word and else only words of layout and numbers, so that no slug
    of a heading is taken for it."""
    rest = {w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", name) if w and not w.isdigit()} - _LAYOUT_WORDS
    longest = 2 * max(map(len, bad | _LAYOUT_WORDS))  # of a longer one no two parts are listed
    return bool(rest) and all(w in bad or len(w) <= longest and any(_fused(w[:i], w[i:], bad) for i in range(3, len(w) - 2)) for w in rest)


def _fused(a: str, b: str, bad: set[str]) -> bool:
    """Whether two words written as one, as in "cookiebar", are bad ones or a bad one and one of layout."""
    return a in bad and (b in bad or b in _LAYOUT_WORDS) or a in _LAYOUT_WORDS and b in bad


def _judge(tag: str, raw: str, later: bool, inside: bool) -> tuple[int, int, bool]:
    """(KEEP, DROP, PART or COMMENTS, weight, named like content) of an element; later: it stands in or after an
    article, inside: in one. PART and COMMENTS are left to ``_leave_out``. Of elements that are no containers only
    those marked as adverts or hidden by class go, and of articles the comments on an earlier one."""
    if tag in _DROP and not (tag == "header" and inside):  # an article's own header holds its title
        return DROP, 0, False
    part = PART if tag == "form" else KEEP
    if not raw or raw == "/":
        return part, 25 if tag in ("article", "main") else 0, tag in ("article", "main")
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "").lower()):
        return DROP, 0, False
    role = a.get("role", "").lower()
    if role in _BAD_ROLE and tag not in ("body", "html"):
        return DROP, 0, False
    classes = a.get("class", "").lower().split()
    names = [*classes, *a.get("id", "").lower().split()]
    words = {w for n in names for w in re.split(r"[^a-z0-9]+", n)}
    good = tag in ("article", "main") or role in ("main", "article")
    if tag in _CONTENT or good:
        if tag not in ("body", "html", "main") and role != "main" and later and "comment" in classes:
            part = COMMENTS
    elif tag in _CONTAINERS:
        bad = [n for n in names if _bad_name(n, _BAD_WORDS)]
        if bad and not any(set(re.split(r"[^a-z0-9]+", n)) & _GOOD_WORDS for n in names if n not in bad):
            part = COMMENTS if any(_bad_name(n, _COMMENT_WORDS) for n in bad) else PART
    elif any(_bad_name(n, _AD_WORDS) for n in classes):
        return DROP, 0, False
    return part, 25 * good + 15 * bool(words & _GOOD_WORDS), good


class _Stack:
    """Open elements, with the places of each tag, of blocks and of scopes, so that no question walks it."""

    def __init__(self, root: _Node):
        self.items: list[tuple[str, _Node]] = [("#root", root)]
        self.at: dict[str, list[int]] = {}
        self.blocks, self.scopes = [0], [0]

    def push(self, tag: str, node: _Node) -> None:
        i = len(self.items)
        self.items.append((tag, node))
        self.at.setdefault(tag, []).append(i)
        if tag not in _INLINE:
            self.blocks.append(i)
        if tag in _SCOPE:
            self.scopes.append(i)

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of the tags, -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def cut(self, to: int) -> int:
        """Close the elements from place to on; the number of links among them."""
        links = 0
        while len(self.items) > to:
            tag, _ = self.items.pop()
            self.at[tag].pop()
            links += tag == "a"
        for places in (self.blocks, self.scopes):
            while places[-1] >= to:
                places.pop()
        return links


def _parse(page: str) -> tuple[list[_Node], list[tuple[str, _Node]]]:
    """The tree's nodes, parents before children, and its text blocks, each with its innermost block element."""
    root = _Node("#root", None, 0, 0, False, KEEP)
    nodes, stack = [root], _Stack(root)
    blocks: list[tuple[str, _Node]] = []
    parts: list[str] = []
    later = False
    linked = skip = in_link = 0  # skip: depth of the stack above which everything is dropped
    unclosed: set[str] = set()  # raw elements without a later end tag

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                owner = stack.items[stack.blocks[-1]][1]
                blocks.append((text, owner))
                chars, link = len(text), min(linked, len(text))
                owner.chars += chars
                owner.link_chars += link
                if chars >= 25 or owner.tag in _POINTS:
                    owner.points += (1 + text.count(",") + text.count("，") + min(chars // 100, 3)) * (1 - link / chars)
        linked = 0

    def close(to: int) -> None:
        nonlocal skip, in_link
        if stack.blocks[-1] >= to:
            flush()
        in_link -= stack.cut(to)
        if skip and len(stack.items) < skip:
            skip = 0

    pos, end_of = 0, page.rfind(">") + 1  # no tag ends behind it
    while True:
        m = _TOKEN.search(page, pos, end_of)
        text = page[pos : m.start()] if m else page[pos:].split("<!--", 1)[0]
        if text and not skip:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        pos = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["cdata"] and not skip:
                parts.append(_html.escape(m["cdata"]))
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            i = stack.last(tag)
            if i > 0 and (tag not in _INLINE or i > stack.blocks[-1]):
                close(i)
            elif tag == "p":
                flush()
            continue
        raw = (m["attrs"] if m["attrs"] is not None else m["attrs2"]) or ""
        if tag in _RAW:
            stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            if stop:
                pos = stop.end()
            elif tag in ("script", "style", "textarea", "title"):
                pos = len(page)
            else:
                unclosed.add(tag)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif not skip:
                parts.append(" ")
            continue
        if tag not in _INLINE:
            i = stack.last("p")  # a block ends an open paragraph
            if i > stack.scopes[-1]:
                close(i)
            if tag in _CLOSES:
                i = stack.last(*_CLOSES[tag])
                if i > stack.last(*_LISTS):
                    close(i)
            flush()
        part, weight, good = _judge(tag, raw, later, stack.last("article", "main") > 0)
        later = later or tag == "article" and part == KEEP and not skip
        node = parent = stack.items[-1][1]
        if tag not in _INLINE:
            node = _Node(tag, parent, weight, len(nodes), good, part)
            nodes.append(node)
        stack.push(tag, node)
        in_link += tag == "a"
        if part == DROP and not skip and raw[-1:] != "/":
            if tag in _INLINE:
                parts.append(" ")
            skip = len(stack.items)
    flush()
    return nodes, blocks


def _leave_out(nodes: list[_Node]) -> list[bool]:
    """For each node whether it goes: with a part of the page that is named as such while enough other
    text is left. Judged from the root: what is kept whatever its name holds further parts."""
    unlinked = [n.chars - n.link_chars for n in nodes]
    plain = list(unlinked)  # unlinked text outside named parts
    for n in reversed(nodes):
        if n.parent is not None:
            unlinked[n.parent.index] += unlinked[n.index]
            plain[n.parent.index] += 0 if n.part in (PART, COMMENTS) else plain[n.index]
    gone = [False] * len(nodes)
    rest = plain[0]
    for n in nodes:
        if n.parent is not None and gone[n.parent.index]:
            gone[n.index] = True
        elif n.part in (PART, COMMENTS) and unlinked[n.index]:
            gone[n.index] = rest > 0 if n.part == COMMENTS else rest >= BESIDE * unlinked[n.index]
            if not gone[n.index]:
                rest += plain[n.index]
                n.weight -= 25
    return gone


def extract(page: str | None) -> str:
    """The article's text blocks, one a line."""
    if not page:
        return ""
    nodes, blocks = _parse(page)
    if not blocks:
        return ""
    gone = _leave_out(nodes)
    for n in reversed(nodes):  # from the leaves: what a node has gathered goes to its parent
        if gone[n.index]:
            n.chars = n.link_chars = 0
            continue
        own = n.tag in _TEXT
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars
            n.parent.points += n.points if own else n.points / 2
        n.score = 0.0 if own else n.points
    best = max(nodes, key=lambda n: (n.chars > 0, (n.score + n.weight * (n.chars > 0)) * (1 - n.link_chars / max(n.chars, 1)), -n.index))
    kept = {best.index} | _siblings(nodes, best)
    inside: list[bool] = []
    for n in nodes:
        inside.append(not gone[n.index] and (n.index in kept or n.parent is not None and inside[n.parent.index]))
    return "\n".join(t for t, n in blocks if inside[n.index])


def _siblings(nodes: list[_Node], best: _Node) -> set[int]:
    """Siblings of the best container that score near it, or paragraphs that read like prose. Among
    articles the score alone decides, however short they are."""
    if best.parent is None:
        return set()
    near, out = 0.2 * best.score, set()
    for n in nodes:
        if n.parent is best.parent and n is not best and n.chars:
            density = n.link_chars / n.chars
            if n.score * (1 - density) >= (near if best.good and n.good else max(10.0, near)) or n.tag in ("p", "h1", "h2", "blockquote", "pre") and density < 0.25 and n.chars > (80 if n.tag == "p" else 0):
                out.add(n.index)
    return out


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            texts = [extract(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def html_extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages: one map, without a shuffle."""
    rows = pages.selectExpr("cast(page_id as long) AS page_id", "url", "html")
    return rows.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")
