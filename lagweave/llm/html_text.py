"""Main text of web pages by composite text density.

A page is read into a tree leniently: optional end tags are implied, script and style contents are skipped, unknown or
broken markup is dropped. Subtrees that page structure names as menus, headers, footers, sidebars, adverts, notices,
forms or reader comments go first. A class, id or role all of whose words are such names is one; with other words
beside them ("content has-sidebar", "sidebar-left") it only counts if the subtree doesn't hold most of the page's
unlinked text, and for names that articles use as well ("related-work") only if the subtree is mostly links.

For every other node the composite density is its characters per tag, adjusted by the logarithm of how rarely its
characters and tags are links. The container whose children's densities sum highest lies in the article; quotations,
lists, tables and single paragraphs are no containers, so they don't win alone. The least density on its path up to
the body is the threshold. The article is the article or main element around it if that holds most of the unlinked
text; else it reaches up that path to the last node that has another child at or above the threshold, or a heading.
Nothing inside goes, be it linked or not, but groups of links before the first and after the last other text of a node
that was reached so; of the body itself only the children at or above the threshold are taken.

Edge cases: null and empty pages and pages without text give ''. Texts are never cut. Rows that repeat are each
returned; an empty table gives an empty result. Extra columns of any name are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, pieces

# Element names of HTML by their part in a page, and words of class, id and role that name such parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form fieldset legend label datalist output progress meter script style noscript template iframe svg canvas button select textarea head title dialog menu object video audio".split())
CONTENT = frozenset("article main".split())
#: Elements that group blocks, not single paragraphs, headings, items or inline elements.
GROUPS = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre caption figcaption summary br hr option".split())
#: Those that can be an article by themselves.
CONTAINERS = frozenset("article main section div body center td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs footer comment comments disqus replies respond "
    "share sharing social related recommended recommendations widget widgets toolbar pagination pager login search skip contentinfo complementary hidden".split()
)
#: Those of NAMED that hold readers' texts, which may be articles themselves.
READERS = frozenset("comment comments disqus replies respond".split())
#: Those of NAMED that also name parts of articles, when they stand beside other words.
SHARED = frozenset("related recommended recommendations social share sharing notice notices alert search login skip hidden promo promotion respond replies banner widget subscription".split())
#: Words of names that say nothing of what a part holds.
FILLER = frozenset("this that post page us on in at it the our your my all more buttons button links link list items item box bar block wrap wrapper container section area icons icon tools left right top bottom inner outer".split())
#: Words of names that say what stands beside or inside a part, not what it is.
BESIDE = frozenset("has with without no".split())
HEADERS = frozenset("header masthead banner topbar".split())
#: An open element that a start tag of the key's kind ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main body td th".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|</?([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
_BROKEN = re.compile(r"<!--|<[a-zA-Z/!?]")
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_GONE = re.compile(r"""\shidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("chars", "density", "items", "link_chars", "links", "named", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, named: str = ""):
        self.tag, self.parent, self.named, self.items = tag, parent, named, []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.sum = 0.0


def _names(attributes: str) -> list[list[set[str]]]:
    """The words of each name in each class, id and role."""
    return [[{w.lower() for w in _PART.findall(name)} for name in (m[2] or m[3] or m[4] or "").split()] for m in _NAME.finditer(attributes)]


def _unwanted(tag: str, attributes: str, in_content: bool) -> tuple[bool, str, bool]:
    """Whether an element is no content, what its names say of it beside others, and whether it holds readers' texts."""
    names = _names(attributes) if attributes else []
    readers = any(w and w <= NAMED and w & READERS for x in names for w in x)
    if tag in DROPPED or attributes and _GONE.search(attributes):
        return True, "", readers
    if tag in ("body", "html", *CONTENT):
        return False, "", False
    top = tag == "header" or any(w & HEADERS for x in names for w in x)
    inside = top and in_content
    if tag == "header":
        return not inside, "", readers
    bad = NAMED - HEADERS if inside else NAMED | HEADERS
    if any(x and all(w and w <= bad for w in x) for x in names):
        return True, "", readers
    if any(w and w & bad and w <= bad | FILLER for x in names for w in x):
        return False, "plain", readers
    beside = set().union(*[w & bad for x in names for w in x if not w & BESIDE])
    return False, "plain" if beside - SHARED else "shared" if beside else "", readers


def _closed(page: str) -> set[int]:
    """Where the start tags stand that an end tag of their own answers."""
    found: set[int] = set()
    opened: dict[str, list[int]] = {}
    at = 0
    for m in _TAG.finditer(page):
        tag = (m[2] or m[4] or "").lower()
        if m.start() < at or not tag:
            continue
        if m[1] if m[2] else m[0].startswith("</"):
            if opened.get(tag):
                found.add(opened[tag].pop())
        elif tag in RAW:
            at = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(page, m.end()).end()
        else:
            opened.setdefault(tag, []).append(m.start())
    return found


class _Open:
    """The open elements, and where those of each tag and the scopes stand among them, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.where: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def end(self, tags: Iterable[str], any_scope: bool = False) -> None:
        """Ends the last open element of these tags and all within it, if it stands within the last scope or may stand outside."""
        at = max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)
        if not at or not any_scope and self.scopes and at < self.scopes[-1]:
            return
        while len(self.stack) > at:
            node = self.stack.pop()
            self.where[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()


def parse(page: str) -> Node:
    """The tree of a page without the parts that its structure names as unwanted."""
    last = page.rfind(">") + 1
    if broken := _BROKEN.search(page, last):
        page = page[: broken.start()]
    root = Node("body", None)
    opened = _Open(root)
    stack = opened.stack
    at, skip, depth = 0, "", 0  # skip: the tag of an unwanted subtree, open depth times
    whole, closed = False, None  # whole: the subtree goes with any articles in it; closed: found once needed
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not skip:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        closes = m[1] if m[2] else m[0].startswith("</")
        if not closes and tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if skip:
            if tag == skip:
                depth += -1 if closes else 1
                skip = skip if depth else ""
            elif tag in CONTENT and not whole or closes and tag in ("body", "html"):
                skip = ""  # an unwanted part that never ended
            if skip or closes or tag not in CONTENT:
                continue
        if closes:
            opened.end((tag,), tag in BLOCK)
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag in BLOCK and tag != "br":
            opened.end({"p"} | ENDS.get(tag, set()))
        in_content = any(opened.where.get(t) for t in CONTENT)
        drop, named, readers = _unwanted(tag, (m[3] if m[2] else m[5]) or "", in_content) if tag not in VOID else (False, "", False)
        if drop:
            if not (m[0].endswith("/>")):
                skip, depth = tag, 1
                if readers and closed is None:
                    closed = _closed(page)
                whole = readers and m.start() in closed
            continue
        node = Node(tag, stack[-1], named)
        stack[-1].items.append(node)
        if tag not in VOID and not m[0].endswith("/>"):
            opened.push(node)
    if at < len(page) and not skip:
        stack[-1].items.append(page[at:])
    return root


def measure(root: Node) -> list[Node]:
    """Sets counts, densities and sums of all nodes; they are returned parents first."""
    order = [root]
    for node in order:
        order.extend(x for x in node.items if isinstance(x, Node))
    for node in reversed(order):
        inside = [x for x in node.items if isinstance(x, Node)]
        node.chars = sum(len("".join(x.split())) for x in node.items if isinstance(x, str)) + sum(x.chars for x in inside)
        node.tags = len(inside) + sum(x.tags for x in inside)
        node.links = sum(x.links + (x.tag == "a") for x in inside)
        node.link_chars = node.chars if node.tag == "a" else sum(x.link_chars for x in inside)
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        node.density = 0.0
        if node.chars:
            rest = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / rest * node.link_chars + share * node.chars + math.e)
            rarity = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.links, 1)
            node.density = node.chars / max(node.tags, 1) * max(math.log(max(rarity, 1.0)), 0.0) / max(math.log(base), 0.1)
        node.sum = sum(x.density for x in node.items if isinstance(x, Node))
    return order


def _prune(order: list[Node]) -> bool:
    """Takes named subtrees out that don't hold most of the unlinked text, of names that articles share only those mostly of links."""
    most = (order[0].chars - order[0].link_chars) / 2
    gone = {n for n in order if n.named and n.chars - n.link_chars <= most and (n.named == "plain" or 2 * n.link_chars > n.chars)}
    for up in {n.parent for n in gone}:
        up.items = [x for x in up.items if x not in gone]
    return bool(gone)


def _trim(root: Node) -> None:
    """Takes groups of links out that stand at either end of a node, unless it is all links."""
    text = [i for i, x in enumerate(root.items) if (x.strip() if isinstance(x, str) else x.chars and not (x.tag in GROUPS and x.links > 1 and x.link_chars == x.chars))]
    if text and root.chars > root.link_chars:
        root.items = root.items[text[0] : text[-1] + 1]


def _write(node: Node, blocks: list[list[str]]) -> None:
    """Depth first without recursion: text goes to the last block, block elements open a new one on either side."""
    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(html.unescape(x) if "&" in x else x)
        else:
            if x.tag in BLOCK:
                blocks.append([])
                todo.append(None)
            todo.extend(reversed(x.items))


def _article(root: Node, order: list[Node]) -> list[Node]:
    """The nodes to write, in page order."""
    best = max((n for n in order if n.tag in CONTAINERS), key=lambda n: n.sum)
    if not best.sum:
        best = root
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    most = (root.chars - root.link_chars) / 2
    around = next((n for n in path if n.tag in CONTENT and n.chars - n.link_chars >= most), None)
    if around:
        return [x for x in around.parent.items if x is around or isinstance(x, Node) and x.tag == around.tag and x.sum and x.density >= threshold]

    def joins(x: Node | str, on_path: Node) -> bool:
        if not isinstance(x, Node) or x is on_path or x.chars == x.link_chars:
            return False
        return x.tag in HEADINGS or x.density >= threshold and (x.tag not in CONTAINERS or x.tag == on_path.tag and x.sum > 0)

    top, under = best, best
    for below, node in zip(path, path[1:]):  # noqa: B905
        if any(joins(x, below) for x in node.items):
            top, under = node, below
    if top is root and top is not best:
        return [x for x in root.items if x is under or joins(x, under)]
    if top is root or top is not best:
        _trim(top)
    return [top]


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by one space."""
    if not page:
        return ""
    root = parse(page)
    order = measure(root)
    if _prune(order):
        order = measure(root)
    blocks: list[list[str]] = [[]]
    for node in _article(root, order):
        _write(node, blocks)
        blocks.append([])
    return " ".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = [main_text(t) for t in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["key", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html)."""
    rows = pages.select(F.col("page_id").alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, keyed(rows, "url string, text string, n_chars long")).withColumnRenamed("key", "page_id")
