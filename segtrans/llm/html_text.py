"""Main text of HTML pages by composite text density.

For every node the characters per tag are weighed down by its share of link text;
the density sum of a node adds its children's. The node of greatest sum holds the
article, and the least density on its path to the body is what a node needs to
count as content elsewhere. Menus, notices and the like are told by element,
role and class name and taken out beforehand.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
CLOSES = {  # a start tag ends these open elements, looking no further out than the given ones
    **dict.fromkeys(BLOCKS - {"html", "body", "option", "optgroup"}, (("p",), BLOCKS - {"p"})),
    "li": (("li", "p"), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (("dt", "dd", "p"), frozenset(("dl",))), "dd": (("dt", "dd", "p"), frozenset(("dl",))),
    "tr": (("tr", "td", "th", "p"), frozenset(("table", "thead", "tbody", "tfoot"))),
    "td": (("td", "th", "p"), frozenset(("tr", "table"))), "th": (("td", "th", "p"), frozenset(("tr", "table"))),
    "option": (("option",), frozenset(("select", "datalist"))),
}
ARTICLES = frozenset(("article", "main"))
KEPT = ARTICLES | {"html", "body"}
DROPPED = RAW | frozenset(
    "head nav footer aside form button select input datalist template svg canvas object audio video map menu "
    "dialog".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Parts of class names and ids that mark what is not the article.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notification popup modal overlay "
    "newsletter subscribe subscription login signup comment comments respond disqus social share sharing related "
    "recommended widget toolbar pagination pager masthead".split())
NAMED_WEIGHT = 2  # so much denser than the rest is an article in a node of such a name
NESTED = 20
SITE_HEADERS = frozenset(("header",))  # as element or name, unless inside an article


class Node:
    __slots__ = ("chars", "density", "items", "link_chars", "link_tags", "named", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, named: bool = False):
        self.tag, self.parent, self.items, self.named = tag, parent, [], named
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0


def _in_article(node: Node | None) -> bool:
    while node:
        if node.tag in ARTICLES:
            return True
        node = node.parent
    return False


def _dropped(tag: str, attributes: str, parent: Node) -> tuple[bool, bool]:
    """Whether an element is dropped for what it is, and whether its names speak against it."""
    if tag in KEPT:
        return False, False
    if tag in DROPPED or (tag in SITE_HEADERS and not _in_article(parent)):
        return True, False
    if "=" not in attributes and "hidden" not in attributes:
        return False, False
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if values.get("role", "").lower() in DROPPED_ROLES or values.get("aria-hidden") == "true":
        return True, False
    bare = ATTRIBUTE.sub(" ", attributes).lower().replace("/", " ").split()  # attributes without a value
    if re.search(r"display\s*:\s*none", values.get("style", "")) or "hidden" in values or "hidden" in bare:
        return True, False
    parts = {p.lower() for p in NAME_PART.findall(values.get("class", "") + " " + values.get("id", ""))}
    return False, bool(parts & DROPPED_NAMES) or bool(parts & SITE_HEADERS and not _in_article(parent))


def parse(page: str) -> list[Node]:
    """Nodes in page order without the dropped ones; the first is the root. Never fails on bad markup."""
    at, root = 0, Node("body", None)
    nodes, here = [root], root
    skipped: list[str] = []  # open elements of a dropped subtree
    tags_end = page.rfind(">") + 1  # no tag ends behind it, so none is looked for
    while True:
        tag = TAG.search(page, at, tags_end) if at < tags_end else None
        text = page[at:tag.start()] if tag else page[at:].split("<!--", 1)[0]
        if text and not skipped:
            here.items.append(html.unescape(text))
        if not tag:
            return nodes
        at = tag.end()
        if tag[0].startswith("<!--") and not tag[0].endswith("-->"):
            at = len(page)  # a comment that is never closed
        if not tag[2]:
            continue
        name = tag[2].lower()
        if tag[1]:
            if skipped:
                if name in skipped:
                    while skipped.pop() != name:
                        pass
                elif name in ("body", "html"):
                    skipped.clear()
                continue
            up = here
            while up and up.tag != name:
                up = up.parent
            if up and up.parent:
                here = up.parent
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
            close = page.find(">", at)
            at = close + 1 if end and close >= 0 else len(page)
            continue
        if skipped:
            if name not in VOID:
                # An unclosed head, or a form around the page, does not hide the article.
                if name == "body" or name in ARTICLES and skipped[0] in ("head", "form"):
                    skipped.clear()
                else:
                    if name in CLOSES and skipped[-1] in CLOSES[name][0]:
                        skipped.pop()
                    skipped.append(name)
                    continue
            else:
                continue
        if name in ("html", "body"):
            continue
        if name in CLOSES:
            ended, bound = CLOSES[name]
            up, last = here, None
            while up.parent and up.tag not in bound - frozenset(ended):
                if up.tag in ended:
                    last = up
                up = up.parent
            if last:
                here = last.parent
        dropped, named = _dropped(name, tag[3], here)
        if dropped:
            here.items.append(Node("", here) if name in BLOCKS else " ")  # it still parts blocks
            if name not in VOID and not tag[3].endswith("/"):
                skipped.append(name)
            continue
        node = Node(name, here, named)
        here.items.append(node)
        nodes.append(node)
        if name not in VOID:
            here = node


def _settle_outermost(nodes: list[Node]) -> list[Node]:
    """Drop or keep the outermost named nodes; those inside a kept one are left for the next turn."""
    weigh(nodes)
    outer: dict[int, Node | None] = {}  # the outermost named node around each node
    best: dict[int, float] = {}  # greatest sum in each of these
    rest: dict[int, float] = {}  # sums of the other nodes, without the named ones
    holders = set()
    for node in nodes:
        outer[id(node)] = top = (outer[id(node.parent)] if node.parent else None) or (node if node.named else None)
        if top:
            best[id(top)] = max(best.get(id(top), 0.0), node.sum, node.density)
            if node.tag in ARTICLES and node.chars and not _in_article(node.parent):
                holders.add(id(top))
        elif node.parent:
            rest[id(node.parent)] = rest.get(id(node.parent), 0.0) + node.density
    least = NAMED_WEIGHT * max(rest.values(), default=0.0)
    gone, at = set(), {}
    for node in nodes:
        if node.parent and id(node.parent) in gone:
            gone.add(id(node))
        elif outer[id(node)] is node:
            if id(node) in holders or best[id(node)] > least:
                node.named = False
            else:
                gone.add(id(node))
                at[id(node.parent)] = node.parent
    for parent in at.values():
        parent.items = [
            (Node("", parent) if x.tag in BLOCKS else " ") if isinstance(x, Node) and id(x) in gone else x
            for x in parent.items]  # it still parts blocks
    found = [n for n in nodes if id(n) not in gone]
    for node in found:
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        node.density = node.sum = 0.0
    return found


def settle(nodes: list[Node]) -> list[Node]:
    """The nodes without those whose names mark them, unless such a node is a wrapper of the article.

    It is one if it holds an ``article`` or ``main`` that is in no other, or if
    the greatest density sum in it is more than ``NAMED_WEIGHT`` times that of
    the rest. Beyond ``NESTED`` named nodes one in another, names mean nothing.
    """
    for _ in range(NESTED):
        if not any(n.named for n in nodes):
            break
        nodes = _settle_outermost(nodes)
    return nodes


def weigh(nodes: list[Node]) -> None:
    """Composite densities and their sums, children before parents."""
    for node in reversed(nodes):
        for item in node.items:
            if isinstance(item, str):
                node.chars += len("".join(item.split()))
            elif item.tag:
                node.chars += item.chars
                node.link_chars += item.link_chars
                node.tags += item.tags + 1
                node.link_tags += item.link_tags + (item.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        if node.chars:
            tags, links = max(node.tags, 1), max(node.link_chars, 1)
            base = math.log(node.chars / max(node.chars - node.link_chars, 1) * links + share * node.chars + math.e)
            ratio = node.chars / links * tags / max(node.link_tags, 1)
            node.density = max(0.0, node.chars / tags * math.log(ratio) / math.log(base))
        if node.parent:
            node.parent.sum += node.density
    if not any(n.sum for n in nodes):
        body.sum = 1.0


def choose(nodes: list[Node]) -> list[Node]:
    """The content nodes in page order, none inside another."""
    best = max(nodes, key=lambda n: n.sum)  # the first of equals
    up, marked_up = best, {}
    while up:
        marked_up[up.tag] = up
        up = up.parent
    for tag in ("article", "main"):  # the page says where its article begins and ends
        if tag in marked_up:
            return [marked_up[tag]]
    threshold, up = best.density, best
    while up:
        threshold = min(threshold, up.density)
        up = up.parent
    # In the subtree of each node that is dense enough, the node of greatest sum is content.
    strongest: dict[int, Node] = {}
    for node in reversed(nodes):
        strongest[id(node)] = top = max([node, *(strongest[id(c)] for c in node.items
                                                if isinstance(c, Node) and c.tag)], key=lambda n: n.sum)
        if not top.sum:
            strongest[id(node)] = node
    marked = set()
    for node in nodes:
        if node.density >= threshold and node.chars:
            marked.add(id(strongest[id(node)]))
    chosen, inside = [], set()
    for node in nodes:
        if node.parent and id(node.parent) in inside:
            inside.add(id(node))
        elif id(node) in marked:
            chosen.append(node)
            inside.add(id(node))
    return chosen or [nodes[0]]


def _is_link_list(node: Node) -> bool:
    return node.tag in BLOCKS and node.link_tags >= 3 and node.link_chars >= 0.8 * node.chars


def blocks(node: Node) -> Iterator[str]:
    """The text of each block below the node, white space as one space, empty ones left out."""
    parts: list[str] = []
    stack: list = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        if item is None or item.tag in BLOCKS or not item.tag:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                yield text
            if item is None:
                continue
        if item.tag == "br":
            parts.append(" ")
        if not node.parent and item is not node and _is_link_list(item):  # a menu; links in an article are its text
            continue
        if item.tag in BLOCKS:
            stack.append(None)
        stack.extend(reversed(item.items))
    text = " ".join("".join(parts).split())
    if text:
        yield text


def main_text(page: str | None) -> str:
    """The article of a page; empty if there is no page or no text in it."""
    if not page:
        return ""
    nodes = settle(parse(page))
    weigh(nodes)
    return "\n\n".join(text for node in choose(nodes) for text in blocks(node))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    Null or empty html gives the empty text; null ids and urls stay null; pages
    are whole, whatever their length; repeated rows give equal rows; an empty
    table none. A scan without a shuffle.
    """
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
