"""Main text of web pages by composite text density.

A page becomes a tree of elements, as browsers build it for the usual faults (unclosed tags, raw text in scripts).
Every node gets its composite text density, the characters per tag adjusted for links, and the sum of its
children's densities. Elements that are never article text (menus, footers, sidebars, forms, headers outside the article,
hidden parts) and elements whose class, id or role has a word of doubt (share, comments, advert) weigh like link text.
The deepest node of the largest sum is the core. On the path from the core to the body lies the least density; at
every step of the path the core's neighbours are taken in if their density reaches it. Neighbouring leaf blocks
(paragraphs, headings, items) are judged as one run, so a short paragraph stands with those around it, and a
heading is judged with what follows it; an element in doubt is judged by itself. If the body itself is the core, its parts
are judged so. Within what is taken, parts without any density go, as do lists that are mostly links. Words of doubt
thus take nothing away by themselves: they lower a density, and what has text enough around them is kept.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by one
space in page order; nothing is capped, and very long pages are read like others, one at a time. Of equal sums the deepest
node, and of these the first in page order, is the core. Null, empty and text-free pages give an empty text. If no
text of a page has a density, the marks are ignored. Columns of the result replace columns of the same
name; all others are kept. Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.blocks import add_columns

# Fixed values of HTML: elements without content, of raw text, that stand in a line, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

#: Elements that aren't article text, and words of class, id and role that lower a density.
OUTSIDE = frozenset("nav footer aside form button select dialog menu object canvas svg math audio video map datalist".split())
WORDS = frozenset("""ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus
footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promotion
related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets
complementary contentinfo alertdialog alert""".split())
HEAD_WORDS = frozenset(("header", "head", "banner", "masthead", "topbar"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TOKEN = re.compile(r"""<!--[\s\S]*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)""")
_MARKS = re.compile(r"""(class|id|role|style|aria-hidden|hidden)\b(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("children", "chars", "density", "doubted", "link_chars", "link_tags", "marks", "outside", "own", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, marks: str, parent: Node | None):
        self.tag, self.marks, self.parent, self.outside, self.doubted = tag, marks, parent, False, False
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """The tree; strings among the children are text. Open elements are counted by name, so that a tag that ends nothing costs nothing."""
    root = at = Node("#root", "", None)
    here = 0
    open_: dict[str, int] = {}

    def text(piece: str) -> None:
        if piece:
            at.children.append(entities.unescape(piece) if "&" in piece else piece)

    def leave(node: Node) -> Node:
        """Close all open elements up to and with `node`."""
        up = at
        while up is not node.parent:
            open_[up.tag] -= 1
            up = up.parent
        return up

    while True:
        m = _TOKEN.search(page, here)
        if m is None:
            text(page[here:])
            return root
        text(page[here : m.start()])
        here = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_.get(tag):
                node = at
                while node.tag != tag:
                    node = node.parent
                at = leave(node)
            elif tag == "br":
                at.children.append(Node("br", "", at))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, here)
            here = end.end() if end else len(page)
            continue
        if tag in ENDS:
            ended, bound = ENDS[tag]
            left = sum(open_.get(t, 0) for t in ended)
            node, last = at, None
            while left and node.tag not in bound:
                if node.tag in ended:
                    last, left = node, left - 1
                node = node.parent
            if last is not None:
                at = leave(last)
        elif tag in CLOSES_P and open_.get("p"):
            node = at
            while node.tag != "p" and node.tag in INLINE:
                node = node.parent
            if node.tag == "p":
                at = leave(node)
        new = Node(tag, m[3], at)
        at.children.append(new)
        if tag not in VOID:  # browsers take no notice of a slash before the end
            at = new
            open_[tag] = open_.get(tag, 0) + 1


def outside(node: Node, in_article: bool) -> bool:
    """Whether the element is never article text, by its name, or isn't shown."""
    if node.tag in OUTSIDE or (node.tag in ("header", "head") and not in_article):
        return True
    if node.tag in ("body", "html") or len(node.marks) < 4:
        return False
    for m in _MARKS.finditer(node.marks):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def doubted(node: Node, in_article: bool) -> bool:
    """Whether a word of the element's class, id or role lowers its density."""
    if len(node.marks) < 4 or (node.tag in ("body", "html", "article", "main") and not in_article):
        return False
    for m in _MARKS.finditer(node.marks):
        if m[1].lower() in ("class", "id", "role"):
            words = set(_SPLIT.split((m[2] or m[3] or m[4] or "").lower()))
            if words & WORDS or (not in_article and words & HEAD_WORDS):
                return True
    return False


def mark(root: Node) -> None:
    """Sets `outside` and `doubted` on elements that are so, and on all below them."""
    stack = [(root, False)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n.tag in ("article", "main")
        for c in n.children:
            if not isinstance(c, str):
                c.outside = n.outside or outside(c, inside)
                c.doubted = n.doubted or doubted(c, inside)
                stack.append((c, inside))


def below(n: Node) -> list[Node]:
    return [c for c in n.children if not isinstance(c, str)]


def in_order(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += reversed(below(n))
    return order


def measure(root: Node) -> None:
    """Characters, tags and those of links of every node; then densities and their sums. Marked parts count as links."""
    order = in_order(root)
    for n in reversed(order):
        n.own = sum(len(" ".join(c.split())) for c in n.children if isinstance(c, str))
        n.chars, n.tags, n.link_chars, n.link_tags = n.own, 0, 0, 0
        for c in below(n):
            n.chars, n.tags, n.link_chars, n.link_tags = n.chars + c.chars, n.tags + c.tags + 1, n.link_chars + c.link_chars, n.link_tags + c.link_tags
        if n.outside or n.doubted:
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        elif n.tag == "a":
            n.link_chars, n.link_tags = n.chars, 1
    share = root.link_chars / max(root.chars, 1)
    for n in reversed(order):
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        own = 0.0 if n.outside or n.doubted else density(n.own, 1, 0, 0, share)
        n.sum = own + sum(c.density for c in below(n))


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, adjusted for links; `share` is that of link characters in the page. Links alone have none."""
    tags = max(tags, 1)
    if not chars or (link_chars >= chars and link_tags >= tags):
        return 0.0
    links, anchors = max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / tags * math.log(max(chars / links * tags / anchors, 1.0)) / max(math.log(base + 1), 1e-6)


def link_list(n: Node) -> bool:
    return n.tag in ("ul", "ol", "div", "section", "table") and n.link_tags >= 3 and n.link_chars > 0.6 * n.chars


def leaf(c: Node | str) -> bool:
    """Text, or an element without blocks in it."""
    return isinstance(c, str) or c.tag in INLINE or all(isinstance(x, str) or x.tag in INLINE or x.tag == "br" for x in c.children)


def runs(children: list[Node | str]) -> list[list[Node | str]]:
    """Children that are judged together: neighbouring leaves, a container alone, headings with what follows; one in doubt by itself. Those that are never article text are left out."""
    out: list[list[Node | str]] = []
    open_ = False  # whether the next child joins the last run
    for c in children:
        if not isinstance(c, str) and c.outside:
            continue
        if not isinstance(c, str) and c.doubted:
            out.append([c])
            open_ = False
            continue
        ends = not leaf(c)
        titles = bool(out) and all((isinstance(x, str) and not x.strip()) or (not isinstance(x, str) and x.tag in HEADINGS) for x in out[-1])
        if open_ and (not ends or titles):
            out[-1].append(c)
        else:
            out.append([c])
        open_ = not ends
    return out


def run_density(run: list[Node | str], share: float) -> float:
    nodes = [c for c in run if not isinstance(c, str)]
    chars = sum(n.chars for n in nodes) + sum(len(" ".join(c.split())) for c in run if isinstance(c, str))
    return density(chars, sum(n.tags + 1 for n in nodes), sum(n.link_chars for n in nodes), sum(n.link_tags for n in nodes), share)


def core_of(root: Node) -> Node:
    """The node of the largest sum; of equals the deepest, then the first."""
    best, depth = root, {id(root): 0}
    for n in in_order(root):
        if n.parent is not None:
            depth[id(n)] = depth[id(n.parent)] + 1
        if (n.sum, depth[id(n)]) > (best.sum, depth[id(best)]):
            best = n
    return best


def select(root: Node) -> Node:
    """The article's part of the tree: the core, and what reaches the least density on its path to the body."""
    core = core_of(root)
    path = [core]
    while path[-1].tag != "body" and path[-1].parent is not None:
        path.append(path[-1].parent)
    least, share = min(n.density for n in path), root.link_chars / max(root.chars, 1)
    steps = list(zip(path[:-1], path[1:], strict=True))
    if core.tag in ("body", "html", "#root"):  # no core but the page: its parts are judged
        steps.insert(0, (None, core))
    for low, high in steps:
        high.children = [c for run in runs(high.children) if any(c is low for c in run) or run_density(run, share) >= least > 0 for c in run]
    judged = {id(high) for _, high in steps}
    stack = [path[-1]]
    while stack:  # in what is taken, parts without any density go
        n = stack.pop()
        if id(n) not in judged and not leaf(n):
            n.children = [c for run in runs(n.children) if run_density(run, share) > 0 or not weighs(run) for c in run]
        stack += below(n)
    return path[-1]


def weighs(run: list[Node | str]) -> bool:
    """Whether a run has text in a block or in doubt; a line's own links stand with the line."""
    return any(not isinstance(c, str) and c.chars > 0 and (c.doubted or c.tag not in INLINE) for c in run)


def text_of(root: Node) -> str:
    """Blocks in page order, white space made one space; without marked parts and link lists."""
    pieces: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            pieces.append(n)
        elif n.tag == "br" or n.tag == "hr":
            pieces.append(" ")
        elif not n.outside and not (n is not root and link_list(n)):
            edge = [] if n.tag in INLINE else [" "]
            stack += [*edge, *reversed(n.children), *edge]
        else:
            pieces.append(" ")
    return " ".join("".join(pieces).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    mark(root)
    measure(root)
    if not core_of(root).sum:  # all of it is marked or links, or there is none
        for n in in_order(root):
            n.outside = n.doubted = False
        measure(root)
        if not core_of(root).sum:
            return text_of(root)
    return text_of(select(root))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` with text, the main text, and n_chars, its code points."""

    def make():
        def work(block: pa.Array) -> dict:
            texts = [main_text(p) for p in block.to_pylist()]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return add_columns(pages, html_col, make, T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
