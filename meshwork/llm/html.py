"""Main text of web pages by composite text density.

Each node of the page's tree gets a density: its characters for each tag, less what its links hold. A node's density sum is that of its children. The subtree
of the largest sum is the content; descending from the body by the least density on the path to it drops its thin parts.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame

from meshwork.llm.arrow import add_columns

#: Elements by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "xmp", "noembed", "noframes"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CHROME = {"nav", "footer", "header", "aside", "form", "button", "select", "menu", "dialog", "head", "option", "label", "input"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Elements that end an open one of their kind.
SELF_CLOSING = {"li", "dt", "dd", "td", "th", "tr", "option"}
#: Whole tokens of a class, an id or a role that name what is not the article.
ASIDE = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "contentinfo", "complementary"}
ASIDE |= {"ad-banner", "ad-slot", "comment-list", "comment-section", "comments-area", "comments-section", "cookie-banner", "cookie-consent", "cookie-notice", "main-nav", "reader-comments", "related-posts", "share-buttons", "sidebar-left", "sidebar-right", "site-footer", "site-header", "site-nav", "skip-link", "social-share"}

#: Of the body's text: a subtree named as no content stays if it holds more and a first heading or a main element, or over the second share where the page names no content at all.
MOST_ASIDE, MOST_PLAIN_ASIDE = 0.5, 0.75

# a quote opens only after an equals sign
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parts", "skip", "aside", "lid", "chars", "tags", "links", "link_tags", "density", "total")

    def __init__(self, tag: str, skip: bool = False, aside: bool = False, lid: bool = False):
        self.tag, self.parts, self.skip, self.aside, self.lid = tag, [], skip, aside, lid
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.total = 0.0


def attributes(source: str) -> dict[str, str]:
    """The attributes of a tag by their lower-case names; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _hidden(own: dict[str, str]) -> bool:
    style = "".join(own.get("style", "").lower().split())
    return "hidden" in own or "display:none" in style or own.get("aria-hidden", "").strip().lower() == "true"


def _aside(own: dict[str, str]) -> bool:
    return any(token in ASIDE for name in ("class", "id", "role") for token in own.get(name, "").lower().split())


class _Stack:
    """Open elements, and where those of each tag and those that block an inner end tag stand."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK and node.tag != "p":
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag; 0 if there is none."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def blocked(self, place: int) -> bool:
        """Whether a block other than a paragraph is open within the element."""
        return bool(self.blocks) and self.blocks[-1] > place

    def close(self, place: int) -> None:
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if self.blocks and self.blocks[-1] == len(self.nodes):
                self.blocks.pop()


def parse(page: str) -> Node:
    """A tolerant tree: unclosed elements end with their parents, a block ends an open paragraph, stray end tags are dropped.

    Of a header in an article or main element just the headings are content; other headers are none.
    """
    root = Node("#root")
    stack = _Stack(root)
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s and not stack.nodes[-1].lid:
            stack.nodes[-1].parts.append(entities.unescape(s))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if place := stack.last(tag):
                if tag in BLOCK or not stack.blocked(place):  # an inline end tag does not close blocks
                    stack.close(place)
            elif tag == "p":
                stack.nodes[-1].parts.append(Node("p"))
            continue
        if tag in BLOCK:
            for own in ("p", tag) if tag in SELF_CLOSING else ("p",):
                if (place := stack.last(own)) and not stack.blocked(place):
                    stack.close(place)
        above, own = stack.nodes[-1], attributes(m[3]) if m[3] else {}
        lid = above.lid and tag not in HEADINGS or tag == "header" and bool(stack.last("article") or stack.last("main"))
        skip = tag in RAW or tag in CHROME and tag != "form" and not lid or bool(own) and _hidden(own)
        aside = tag == "form" or bool(own) and tag not in ("html", "body", "article", "main") and _aside(own)
        node = Node(tag, skip, aside and not skip, lid)
        above.parts.append(node)
        if tag in VOID or m[3].rstrip().endswith("/") and tag in RAW:
            continue
        if tag in RAW:  # to its own end tag, whatever stands between
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.push(node)
    _drop_asides(root)
    return root


def _drop_asides(root: Node) -> None:
    """Skip the subtrees that their names call no content, but those that hold most of the page's text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.parts if isinstance(x, Node) and not x.skip)
    if not any(x.aside for x in order):
        return
    size: dict[int, int] = {}
    holds: set[int] = set()
    for node in reversed(order):
        inner = [x for x in node.parts if isinstance(x, Node) and not x.skip]
        size[id(node)] = sum(len(_SPACE.sub(" ", x).strip()) for x in node.parts if isinstance(x, str)) + sum(size[id(x)] for x in inner)
        if any(x.tag in ("h1", "main") or id(x) in holds for x in inner):
            holds.add(id(node))
    named = any(x.tag in ("article", "h1", "main") and not x.aside for x in order)
    body = next((x for x in order if x.tag == "body"), root)
    whole = max(1, size[id(body)])
    for node in order:
        if node.aside:
            share = size[id(node)] / whole
            node.skip = share <= MOST_ASIDE or id(node) not in holds and (named or share <= MOST_PLAIN_ASIDE)


def measure(root: Node) -> list[Node]:
    """Characters, tags, links and link tags of each subtree, in an order of children first; what is not content counts nothing."""
    order, todo = [], [(root, False)]
    while todo:
        node, link = todo.pop()
        order.append((node, link))
        if not node.skip:
            todo.extend((x, link or x.tag == "a") for x in node.parts if isinstance(x, Node))
    order.reverse()
    for node, link in order:
        if node.skip:
            continue
        own = sum(len(_SPACE.sub(" ", x).strip()) for x in node.parts if isinstance(x, str))
        node.chars, node.links = own, own * link
        for x in node.parts:
            if isinstance(x, Node) and not x.skip:
                node.chars, node.links = node.chars + x.chars, node.links + x.links
                node.tags, node.link_tags = node.tags + x.tags + 1, node.link_tags + x.link_tags + (x.tag == "a")
    return [x for x, _ in order if not x.skip]


def weigh(nodes: list[Node], body: Node) -> None:
    """Composite text density C/T * log_b(C/LC * T/LT), b = ln(C * LC / nLC + e * LC_body / C_body + e), and the sum of the children's."""
    ratio = body.links / max(1, body.chars)
    for x in nodes:
        c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.links), max(1, x.link_tags)
        if c:
            plain = max(1, c - x.links)
            base = math.log(c * x.links / plain + ratio * c + math.e)
            inner = max(1.0 + 1e-9, (c / lc) * (t / lt))
            x.density = c / t * math.log(inner) / math.log(max(base, 1 + 1e-9)) if base > 1 else c / t * math.log(inner)
        x.total = sum(k.density for k in x.parts if isinstance(k, Node) and not k.skip)


def content(root: Node) -> Node | None:
    """The content's root: the subtree of the largest density sum, widened.

    The threshold is the least density on the path from the body to that subtree. While a sibling reaches it, the parent is taken; then
    the article or main element around, if there is one. Of that node all is content but its menus and the like: short paragraphs stay.
    """
    nodes = measure(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    if not body.chars:
        return None
    weigh(nodes, body)
    above = {id(k): x for x in nodes for k in x.parts if isinstance(k, Node)}
    inner, todo = [], [body]
    while todo:
        x = todo.pop()
        inner.append(x)
        todo.extend(k for k in x.parts if isinstance(k, Node) and not k.skip)
    best = max(inner, key=lambda x: (x.total, x.chars))
    if best.total <= 0:
        best = body
    path = [best]
    while path[-1] is not body:
        path.append(above[id(path[-1])])
    least = min(x.density for x in path)
    top = best
    while top is not body and any(isinstance(k, Node) and k is not top and not k.skip and k.chars and k.density >= least for k in above[id(top)].parts):
        top = above[id(top)]
    return next((x for x in path[path.index(top) :] if x.tag in ("article", "main")), top)


def blocks(node: Node) -> list[str]:
    """The texts of the node's blocks in page order; white space within one is one space."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        if now and (joined := _SPACE.sub(" ", "".join(now)).strip()):
            out.append(joined)
        now.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            now.append(x)
        elif x is None:
            close()
        elif x.tag == "br":
            now.append(" ")
        elif not x.skip:
            if x.tag in BLOCK:
                close()
                todo.append(None)
            todo.extend(reversed(x.parts))
    close()
    return out


def extract(page: str | None) -> str:
    """The main text of a page: blocks joined by an empty line; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    node = content(root)
    return "\n\n".join(blocks(node)) if node is not None else ""


def extract_text(pages: DataFrame, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with text, the main text of the whole html, and n_chars, its code points.

    Null or empty html, or none but menus and the like: empty text. Repeated rows are extracted each. Elements may be nested to any depth. Columns named
    text or n_chars give way.
    """

    def make():
        def work(pages: list[bytes | None]) -> list:
            out = [extract(p.decode("utf-8")) if p else "" for p in pages]
            return [out, list(map(len, out))]

        return work

    return add_columns(pages, "text string, n_chars long", make, text_col=html_col, keep=keep)
