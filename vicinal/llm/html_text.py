"""Main text of web pages by composite text density.

A page becomes a tree. Elements that by their tag are no text of an article (menus, footers, asides, forms, scripts), or are
hidden, are left out. Every other node gets its composite density: characters for each tag, adjusted by the share of
characters and tags that are in links and by the share of the whole body, and weighed by what its tags and names tell: less outside of
article and main elements where a page has such, less where class, id or role speak of a sidebar, notice, advert or comments. The node
whose child blocks' densities sum to most, a title's counting more, is the middle of the content; the least density on its path to
the body is the page's threshold. Every other container of several blocks that reaches it gives the subtree of largest sum beneath it.
A chosen subtree brings the headings that stand right before it, and grows to the article or main element next around it;
parts within it whose names tell against them stay if they reach the threshold.

Defined results: null or empty html gives an empty text. Broken html is read as far as it goes: tags that are
not closed end with what is around them, what is no tag is text. All white space counts as such, also
from character references. A line break is white space. Repeated rows and extra columns do not matter.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_attribute = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup up to their end tag.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template iframe svg math canvas object embed applet video audio select option button input textarea head title nav footer aside dialog menu form "
    "xmp noembed noframes datalist".split()
)
#: Start tags that end an open paragraph, and open elements that a like start tag ends.
ENDS_P = BLOCKS - {"body", "html", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot"}
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words in class, id and role that speak of what is no article, and those that begin so.
NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs consent cookie cookies footer menu nav navigation newsletter notice popup promo related share sidebar signup "
    "social sponsored subscribe widget".split()
)
NAMES_BEGIN = ("comment", "advert", "cookie", "sidebar", "sponsor", "replies")
#: Weights of densities: of what is named so, of what is outside of article and main elements, and of titles in the sum of their parent.
NAMED, OUTSIDE, TITLES = 0.2, 0.3, {"h1": 5.0, "h2": 3.0}


class Node:
    __slots__ = ("blocks", "chars", "children", "density", "holds_block", "link_chars", "link_tags", "named", "parent", "sum", "tag", "tags", "weight")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.weight, self.blocks = 1.0, 0
        self.holds_block = self.named = False


def not_article(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of an article by its tag or as it is hidden; ``inside``: it is in an article or main element."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    for name, value in _values(attributes):
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def named_so(tag: str, attributes: str) -> bool:
    """Whether class, id or role of an element speak of what is no part of an article."""
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    words = (w for name, value in _values(attributes) if name in ("class", "id", "role") for w in re.split(r"[^a-z0-9]+", value))
    return any(w in NAMES or w.startswith(NAMES_BEGIN) for w in words)


def _values(attributes: str) -> Iterator[tuple[str, str]]:
    for name, *values in _attribute.findall(attributes):
        yield name.lower(), next((v for v in values if v), "").lower()


def parse(page: str) -> Node:
    """The tree of a page without what is no article. Children are nodes and pieces of text."""
    root = Node("body", None)
    stack, at, dropped, n = [root], 0, [], len(page)

    def pop(depth: int) -> None:
        del stack[depth:]
        while dropped and dropped[-1] >= depth:
            dropped.pop()

    def find(tags: set[str], stop: set[str]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stop:
                return 0
        return 0

    while at < n:
        m = _token.search(page, at)
        until = m.start() if m else n
        if until > at and not dropped:
            stack[-1].children.append(html.unescape(page[at:until]))
        if not m:
            break
        at, start, end = m.end(), m.group(2), m.group(1)
        if start:
            tag, attributes = start.lower(), m.group(3)
            if tag in ("html", "body"):
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = n if not close else (page.find(">", close.start()) + 1 or n)
                continue
            if tag in ENDS_P and (i := find({"p"}, {"table", "td", "th", "button", "object"})):
                pop(i)
            if tag in LIKE and (i := find(LIKE[tag], WITHIN[tag])):
                pop(i)
            if tag == "body" or (tag in BLOCKS and tag != "p" and stack[-1].tag == "head"):
                pop(len(stack) - 1)
            node = Node(tag, stack[-1])
            if dropped or not_article(tag, attributes, any(x.tag in ("article", "main") for x in stack)):
                if tag in VOID or attributes.endswith("/") and tag in ("path", "svg"):
                    continue
                stack.append(node)
                if not dropped:
                    dropped.append(len(stack) - 1)
                continue
            node.named = named_so(tag, attributes)
            stack[-1].children.append(node)
            if tag not in VOID:
                stack.append(node)
        elif end:
            tag = end.lower()
            if tag not in ("body", "html") and (i := find({tag}, set())):
                pop(i)
    return root


def in_order(root: Node) -> list[Node]:
    """All nodes, each before its children; without recursion, as pages may be nested deep."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return order


def weigh(order: list[Node]) -> None:
    """What a node's names and place tell, as a weight of its density."""
    whole = [x for x in order if x.tag in ("article", "main") and x.chars and not any(y.named for y in _up(x))]
    around = {id(y) for x in whole for y in _up(x.parent)}
    inside: set[int] = set()
    for x in order:
        up = x.parent
        if x.tag in ("article", "main") or (up is not None and id(up) in inside):
            inside.add(id(x))
        x.named = x.named and id(x) not in around
        named = (1.0 if up is None or id(up) in around else up.weight) * (NAMED if x.named else 1.0)
        x.weight = named * (OUTSIDE if whole and id(x) not in inside and id(x) not in around and (up is None or id(up) in around) else 1.0)


def measure(root: Node) -> list[Node]:
    """Counts of characters and tags of each node, with those in links, then densities and their sums. Returns all nodes."""
    order = in_order(root)
    for node in reversed(order):
        text = False
        for c in node.children:
            if isinstance(c, Node):
                node.chars, node.tags, node.blocks = node.chars + c.chars, node.tags + c.tags + 1, node.blocks + c.blocks
                node.link_chars, node.link_tags = node.link_chars + c.link_chars, node.link_tags + c.link_tags
                node.holds_block |= c.holds_block or c.tag in BLOCKS
            elif n := len("".join(c.split())):
                node.chars, text = node.chars + n, True
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.tag in BLOCKS and not node.blocks and (node.chars or text):
            node.blocks = 1
    weigh(order)
    body_share = root.link_chars / max(root.chars, 1)
    for node in order:
        if node.chars:
            c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - node.link_chars, 1) * lc + body_share * c + math.e)
            plain = c / t * max(math.log(c / lc * t / lt), 0.0) / math.log(base) if base > 1 and math.log(base) > 1e-9 else c / t
            node.density = node.weight * plain
    for node in order:
        node.sum = sum(c.density * TITLES.get(c.tag, 1.0) for c in node.children if isinstance(c, Node) and c.tag in BLOCKS)
    return order


def titles_before(node: Node) -> list[Node]:
    """The headings that stand right before a subtree, with no other text between."""
    found: list[Node] = []
    while node.parent is not None:
        parent = node.parent
        before = parent.children[: next(i for i, c in enumerate(parent.children) if c is node)]
        for c in reversed(before):
            if isinstance(c, Node) and c.tag in HEADINGS and c.chars:
                found.append(c)
            elif c.chars if isinstance(c, Node) else c.strip():
                return found
        node = parent
    return found


def content_nodes(root: Node) -> list[Node]:
    """The chosen subtrees, in page order and none within another. What is left out of them is cut off."""
    order = measure(root)
    holders = [x for x in order if x.holds_block and x.chars]
    if not holders:
        return [root]
    best = max(holders, key=lambda x: x.sum)
    threshold, up, path = best.density, best, set()
    while up is not None:
        threshold, up, _ = min(threshold, up.density), up.parent, path.add(id(up))
    # the largest sum beneath each node
    under: dict[int, Node] = {}
    for x in reversed(order):
        own = x if x.holds_block else None
        for c in x.children:
            if isinstance(c, Node) and (y := under.get(id(c))) is not None and (own is None or y.sum > own.sum):
                own = y
        if own is not None:
            under[id(x)] = own
    chosen, todo = [best], [root]
    while todo:
        x = todo.pop()
        if id(x) not in path and x.holds_block and x.blocks > 1 and x.density >= threshold - 1e-9 and (x.chars - x.link_chars) * 2 > x.chars:
            chosen.append(under[id(x)])
        elif x is not best:
            todo += [c for c in x.children if isinstance(c, Node) and c.tag in BLOCKS]
    grown = {}
    for x in chosen:
        top = x
        while top.parent is not None and top.tag not in ("article", "main"):
            top = top.parent
        top = top if top.tag in ("article", "main") else x
        for y in (top, *titles_before(top)):
            grown[id(y)] = y
    kept = {id(z) for y in (best, *grown.values()) for z in _up(y)}
    out = []
    for x in order:
        if id(x) in grown and not any(id(y) in grown for y in _up(x) if y is not x):
            out.append(x)
        x.children = [c for c in x.children if not (isinstance(c, Node) and c.named and c.tag in BLOCKS and c.chars and id(c) not in kept and c.density < threshold - 1e-9)]
    return out


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def blocks_of(node: Node, out: list[str]) -> None:
    """Add the text of each block in a subtree, in page order."""
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        elif x.tag in BLOCKS:
            flush()
            todo.append(None)
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)
    flush()


def extract(page: str | None) -> str:
    if not page:
        return ""
    out: list[str] = []
    for node in content_nodes(parse(page)):
        blocks_of(node, out)
    return "\n".join(out)


def extract_udf():
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(extract, na_action=None)

    return text


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with text, its blocks a line each, and n_chars in place of html."""
    ship(pages.sparkSession)
    return pages.withColumn("text", extract_udf()("html")).withColumn("n_chars", F.length("text").cast("long")).drop("html")
