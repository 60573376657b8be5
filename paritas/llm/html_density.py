"""Main text of web pages by composite text density.

Every node of a page gets its link-adjusted characters per tag. The node whose children's densities
add up to most is the article's body; the least density on the path from it up to the page's body
is the threshold that other parts must reach to belong to the article as well. Elements that neither
start a block nor link are formatting and count as no tag; direct text counts as one block.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches

# Fixed values of the HTML standard: elements without content, with raw text, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption".split())
#: A start tag ends the open element of these names, up to the nearest of the scopes.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_P_ENDS = BLOCK - {"html", "body", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "caption",
                   "summary"}
#: Elements that are never part of an article.
OUTSIDE = RAW | frozenset(
    "head nav footer aside button select input menu dialog object canvas audio video".split())
#: Words in a class, id or role that mark an element as outside of the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent "
    "gdpr notice notices alert comment comments disqus respond reply replies sidebar sidebars nav navbar "
    "navigation menu menus breadcrumb breadcrumbs footer masthead share sharing social related newsletter "
    "subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager "
    "contentinfo complementary search skip".split())
#: Marks of what readers and notices say; the others also stand in the names of wrappers around an article, such as
#: ``content-sidebar-wrap`` or ``ad-free``.
PLAIN_MARKS = frozenset("comment comments disqus respond reply replies cookie cookies consent gdpr".split())
#: A form, or an element with a mark as a part of a name, is a wrapper if it holds so many times the text that stands
#: outside of all of them; else it is left out.
WRAPPER_SHARE = 4
_KEPT_WHOLE = frozenset("html body main article".split())

_TOKENS = re.compile(
    r"[^<]+|<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)(?:>|\Z)"
    r"|<", re.DOTALL)
_MARKED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_WORDS = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("name", "children", "inside", "doubtful", "chars", "tags", "link_chars", "link_tags", "density",
                 "density_sum", "best")

    def __init__(self, name: str, inside: bool, doubtful: bool = False):
        self.name = name
        self.children: list[Node | str] = []
        self.inside = inside
        self.doubtful = doubtful


def _is_outside(name: str, attributes: str, parents: list[Node]) -> tuple[bool, bool]:
    """Whether an element is outside of the article, and whether that depends on the text it holds."""
    if name in OUTSIDE:
        return True, False
    if name in _KEPT_WHOLE:
        return False, False
    if name == "header" and not any(p.name in ("article", "main") for p in parents):
        return True, False
    if _HIDDEN.search(attributes):
        return True, False
    doubtful = name == "form"
    for found in _MARKED.finditer(attributes):
        for token in (found[1] or found[2] or found[3] or "").lower().split():
            words = _WORDS.findall(token)
            marks = MARKS.intersection(words)
            if marks and (len(words) == 1 or marks & PLAIN_MARKS):
                return True, False
            doubtful |= bool(marks)
    return False, doubtful


def settle_doubts(root: Node) -> None:
    """Doubtful elements become plain ones if they wrap most of the text, and are left out else. Outer ones are decided
    first, then those with more text; what a wrapper holds counts as outside for those within. Links are no text here."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and c.name != "a")
    own, whole = {}, {}
    for node in reversed(order):
        own[id(node)] = sum(_visible(c) for c in node.children if isinstance(c, str))
        whole[id(node)] = own[id(node)] + sum(whole.get(id(c), 0) for c in node.children if isinstance(c, Node))
    outside, tops = 0, [root]
    while tops:
        held: list[tuple[Node, Node]] = []  # the nearest doubtful elements below, with their parents
        todo = list(tops)
        while todo:
            node = todo.pop()
            outside += own.get(id(node), 0)
            for child in node.children:
                if isinstance(child, Node):
                    if child.doubtful:
                        held.append((node, child))
                    else:
                        todo.append(child)
        tops, parents, most = [], {}, outside
        for parent, node in sorted(held, key=lambda h: -whole.get(id(h[1]), 0)):
            text = whole.get(id(node), 0)
            if text and text >= WRAPPER_SHARE * most:
                node.doubtful = False
                most += text
                tops.append(node)
            else:
                parents[id(parent)] = parent
        for parent in parents.values():
            parent.children[:] = [c if not isinstance(c, Node) or not c.doubtful else Node("hr", True)
                                  for c in parent.children if not isinstance(c, Node) or not c.doubtful or c.name in BLOCK]


def parse(page: str) -> Node:
    """The page's tree without what lies outside of any article, and with end tags supplied."""
    root = Node("html", True)
    stack = [root]
    raw_end: str | None = None

    def drop_to(depth: int) -> None:
        del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        if raw_end:
            end = re.compile(rf"</{raw_end}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at, raw_end = (end.start() if end else size), None
            continue
        found = _TOKENS.match(page, at)
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            text = found[0]
            if not text.startswith("<!") and not text.startswith("<?") and stack[-1].inside:
                stack[-1].children.append(html.unescape(text))
            continue
        attributes = found[3] if found[2] else found[6]
        if found[1] or found[4]:  # an end tag closes its element and what is open inside it
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    drop_to(depth)
                    break
                if stack[depth].name in ("article", "main", "td", "th") and name not in BLOCK:
                    break
            continue
        if name in ("html", "body"):
            continue
        if name in _P_ENDS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == "p":
                    drop_to(depth)
                    break
                if stack[depth].name in BLOCK:
                    break
        if name in CLOSES:
            closed, scope = CLOSES[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in scope:
                    break
                if stack[depth].name in closed:
                    drop_to(depth)
        if name in ("article", "main", "footer", "nav") and any(n.name == "head" for n in stack):
            drop_to(next(i for i, n in enumerate(stack) if n.name == "head"))
        if name not in VOID and (len(stack) > 1 and stack[-1].name == "head" and name in BLOCK):
            drop_to(len(stack) - 1)
        parent = stack[-1]
        outside, doubtful = _is_outside(name, attributes, stack)
        node = Node(name, parent.inside and not outside, parent.inside and doubtful and name not in VOID)
        if name == "br":
            parent.children.append(" ")
        elif parent.inside and node.inside and name not in BLOCK and name != "a" and not node.doubtful:
            node.children = parent.children  # formatting: its text is its parent's
        elif parent.inside and node.inside:
            parent.children.append(node)
        elif parent.inside and name in BLOCK:
            parent.children.append(Node("hr", True))  # what is left out still parts two blocks
        if name in VOID or attributes.rstrip().endswith("/") and name in ("svg", "path"):
            continue
        stack.append(node)
        if name in RAW and name not in ("noscript", "svg", "template"):
            raw_end = name
    settle_doubts(root)
    return root


def _visible(text: str) -> int:
    words = text.split()
    return sum(map(len, words)) + max(len(words) - 1, 0)


def weigh(root: Node) -> None:
    """Density of every node, bottom-up without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for child in node.children:
            if isinstance(child, str):
                node.chars += _visible(child)
            else:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.name == "a")
        if node.name == "a":
            node.link_chars = node.chars
    link_share = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, link_share)
        inner, direct = 0.0, 0
        for child in node.children:
            if isinstance(child, str):
                direct += _visible(child)
            else:
                inner += child.density
        node.density_sum = inner + composite_density(direct, 1, 0, 0, link_share)
        node.best = node
        for child in node.children:
            if isinstance(child, Node) and child.best.density_sum > node.best.density_sum:
                node.best = child.best


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, link_share: float) -> float:
    """Characters per tag, lowered by the share of characters and tags that are links."""
    if not chars:
        return 0.0
    tags, link_tags = max(tags, 1), max(link_tags, 1)
    lowered = math.log(chars / max(chars - link_chars, 1) * link_chars + link_share * chars + math.e)
    return chars / tags * max(0.0, math.log(chars / max(link_chars, 1) * tags / link_tags)) / lowered


def article_nodes(root: Node) -> list[Node]:
    """The subtrees of the article in page order."""
    weigh(root)
    best = root.best
    path, node = [root], root
    while node is not best:
        node = next(c for c in node.children if isinstance(c, Node) and c.best is best)
        path.append(node)
    threshold = min(n.density for n in path)
    if best is root:
        return [root]
    on_path = set(map(id, path))
    chosen: list[Node] = []
    todo: list[Node] = [root]
    while todo:
        node = todo.pop()
        if node is best or id(node) not in on_path:
            if node is best or node.density >= threshold and node.chars:
                chosen.append(node)
            continue
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return chosen


def blocks(nodes: list[Node]) -> Iterator[str]:
    """Texts of the blocks below ``nodes`` in page order, white space folded, empty ones left out."""
    held: list[str] = []

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        return text

    for top in nodes:
        todo: list[Node | str | None] = [None, top]
        while todo:
            item = todo.pop()
            if item is None:
                if text := flush():
                    yield text
            elif isinstance(item, str):
                held.append(item)
            else:
                is_block = item.name in BLOCK
                if is_block:
                    if text := flush():
                        yield text
                    todo.append(None)
                todo.extend(reversed(item.children))
    if text := flush():
        yield text


def main_text(page: str | None) -> str:
    """The article of one page; empty if there is none."""
    if not page:
        return ""
    return "\n".join(blocks(article_nodes(parse(page))))


_OUT = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    ``pages`` needs page_id, url and html; other columns are ignored. One row per input row, repeated
    rows included. Null or empty html and pages without an article give the empty text. Tags may be
    unclosed and pages cut off anywhere. No row leaves its task; nothing is shuffled.
    """

    def run(rows: pa.RecordBatch):
        texts = [main_text(page) for page in rows.column("html").to_pylist()]
        yield batch(_OUT, page_id=rows.column("page_id"), url=rows.column("url"), text=texts,
                    n_chars=[len(t) for t in texts])

    return map_batches(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.col("html").cast("string").alias("html")),
        run, "page_id long, url string, text string, n_chars long")
