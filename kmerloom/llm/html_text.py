"""Main text of web pages by composite text density.

For every node of a page's tree: characters, tags, characters and tags within links. A node's composite
text density is its characters per tag, scaled by how few of them are links. The densities of a node's
children add up to its density sum, text outside its blocks counting as one more child; the node with the
largest sum holds the content, and all of the article that it stands in. The lowest density on the path from
it up to the body is the threshold: other parts of the page count only if they are no less dense, and link
lists below it are left out.

Menus, headers, footers, asides, forms, code and what is hidden are cut from the tree first, by element, role and
the attributes hidden and aria-hidden. Names (class and id) only lower a node's score: outside the content a named
node counts a quarter of its density, or nothing if the name is one that hardly anything but boilerplate has;
inside the content it is left out only if such a class says so, or if over a third of it is links or its characters per tag are under
an eighth of the body's. Names of headings, and of what holds an h1 or main element, say nothing; nor do any if all
text of a page is in named nodes of no weight.

Defined results: a null, empty or text-free page gives an empty text; markup that is never closed ends
with its parent; character references are decoded once, in text only.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch

SCHEMA = "page_id long, url string, text string, n_chars long"
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
CUT = frozenset("head nav footer aside form script style noscript template iframe button select input textarea label fieldset option svg canvas object embed audio video map dialog menu noembed noframes xmp math".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banners?|sidebars?|side-bar|navs?|navbar|navigation|menus?|breadcrumbs?|footer|foot|comments?|commentlist|replies|reply|responses?|disqus|discussion|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend(?:ed|ations?)?|widgets?|toolbar|pagination|pager|skip|masthead|copyright|legal|disclaimer|rating|tags|tagcloud)(?=$|[\s_-])", re.I)
#: Names that hardly anything but boilerplate has.
CERTAIN = re.compile(r"(?:^|[\s_-])(?<!has-)(?<!with-)(?<!no-)(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|sidebars?|side-bar|navbar|menus?|breadcrumbs?|footer|comments?|commentlist|disqus|cookies?|gdpr|popups?|modal|newsletter|subscribe|signup|login|pagination|pager|masthead)(?=$|[\s_-])", re.I)
#: What names leave of a node's density: those, and other ones of NAMES.
NEVER, DOUBT = 0.0, 0.25
#: Inside the content, named nodes with under this share of the body's characters per tag are left out.
LEAST = 0.125
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that can be the content of a page; others only if blocks are inside.
HOLDS = frozenset("html body address article blockquote center details dir div dl figure main ol section table tbody td th tr ul".split())
#: An end tag that these starts imply.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("html body table td th ul ol dl div article section main aside nav header footer form blockquote".split())

_TOKEN = re.compile(r"<(?:!--(?:.*?-->|.*)|!\[CDATA\[.*?\]\]>|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_TELLING = re.compile(r"class|id|role|hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "items", "cut", "chars", "tags", "link_chars", "link_tags", "run", "holds", "density", "run_density", "sum", "peak", "peak_sum", "weight", "sure", "title")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, weight: float = 1.0, sure: bool = False):
        self.tag, self.parent, self.items, self.cut = tag, parent, [], cut
        self.weight, self.sure, self.title = weight, sure, tag in ("h1", "main")  # what names leave of its density; whether a class says so; whether a title is inside
        self.clear()

    def clear(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.run, self.holds = [0, 0, 0, 0], False  # the same four of text and inline elements outside blocks; whether blocks are inside
        self.density = self.run_density = self.sum = self.peak_sum = 0.0
        self.peak: Node | None = None


def _attributes(written: str) -> dict[str, str]:
    """Names and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(written):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _judge(tag: str, written: str, inside: Node) -> tuple[bool, float, bool]:
    """Whether an element is cut, what its names leave of its density, and whether a class says so."""
    if tag in CUT or tag == "header" and inside.tag not in ("article", "main", "section"):
        return True, 1.0, False
    if not written or tag in ("html", "body", "article", "main") or not _TELLING.search(written):
        return False, 1.0, False
    given = _attributes(written)
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in ROLES:
        return True, 1.0, False
    weight, sure = 1.0, False
    if tag not in HEADINGS:
        for name in ("id", "class"):
            if (value := given.get(name)) and NAMES.search(value):
                certain = CERTAIN.search(value) is not None
                weight = min(weight, NEVER if certain else DOUBT)
                sure = certain and name == "class"
    return False, weight, sure


def parse(page: str) -> Node:
    """The tree of a page; text is kept, as written, among each node's items."""
    root = at = Node("html", None)
    seen = 0
    length = len(page)
    while seen < length:
        m = _TOKEN.search(page, seen)
        if m is None:
            at.items.append(page[seen:])
            break
        if m.start() > seen:
            at.items.append(page[seen : m.start()])
        seen = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            node = at
            while node is not None and node.tag != tag and not (tag not in SCOPE and node.tag in SCOPE):
                node = node.parent
            if node is not None and node.tag == tag and node.parent is not None:
                at = node.parent
            continue
        if tag in ("html",):
            continue
        if tag in BLOCK:
            node = at
            while node.parent is not None and node.tag not in SCOPE:  # a block ends the paragraph that it stands in
                if node.tag == "p" or node.tag in CLOSES.get(tag, ()):
                    at = node.parent
                node = node.parent
        if tag in CLOSES and at.tag in CLOSES[tag] and at.parent is not None:
            at = at.parent
        node = Node(tag, at, *_judge(tag, m[3], at))
        at.items.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, seen)
            seen = end.end() if end else length
            continue
        at = node
    return root


def measure(root: Node) -> Node:
    """Densities, their sums and the largest sums below, of all nodes; returns the body."""
    order, stack = [], [root]
    body = root
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag == "body":
            body = node
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.cut]
    for node in reversed(order):
        if node.title:
            node.weight = 1.0  # whatever its names, what holds the page's title isn't boilerplate
            if node.parent is not None:
                node.parent.title = True
    _sums(order, body)
    if not body.chars and any(x.chars for x in order):  # all text has names of boilerplate: then they say nothing
        for node in order:
            node.weight = 1.0
            node.clear()
        _sums(order, body)
    return body


def _sums(order: list[Node], body: Node) -> None:
    for node in reversed(order):
        own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        node.chars += own
        node.run[0] += own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if (up := node.parent) is not None:
            if block := node.tag in BLOCK or node.holds:
                up.holds = True
            if not node.weight:
                continue
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            if not block:
                up.run = [x + y for x, y in zip(up.run, (node.chars, node.tags + 1, node.link_chars, node.link_tags), strict=True)]
    share = body.link_chars / body.chars if body.chars else 0.0

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        of = c / (lc or 1) * (t or 1) / (lt or 1)
        return c / (t or 1) * math.log(max(of, 1.0)) / math.log(base) if base > 1.0 + 1e-9 else c / (t or 1) * math.log(max(of, 1.0) + 1e-9)

    for node in reversed(order):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags)
        node.run_density = density(*node.run)
        node.sum += node.run_density
        if (node.holds or node.tag in HOLDS) and (node.peak is None or node.sum >= node.peak_sum):
            node.peak, node.peak_sum = node, node.sum
        if (up := node.parent) is not None and node.weight:
            if node.tag in BLOCK or node.holds:
                up.sum += node.density * node.weight
            if node.peak is not None and (up.peak is None or node.peak_sum * node.weight >= up.peak_sum):
                up.peak, up.peak_sum = node.peak, node.peak_sum * node.weight


def content(body: Node) -> tuple[set[Node], float]:
    """Nodes whose text is the page's content, and the threshold.

    The node of the largest density sum gives the threshold: the lowest density on its path up to the body. From the
    body down, each node that isn't below it has the node of the largest sum in it as content. Nodes in the tuple's set
    that hold others only have their text run taken. Elements' names play no part but one: if the largest sum stands
    in an article, all of that article is content.
    """
    best = body.peak or body
    node, threshold, whole = best, best.density, best if best.tag == "article" else None
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
        if whole is None and node.tag == "article":
            whole = node
    found, stack = {whole or best}, [body]
    while stack:
        node = stack.pop()
        if node in found or node.density * node.weight < threshold or not node.chars or not node.weight:
            continue
        found.add(node.peak or node)
        if node not in found:
            stack += [x for x in node.items if isinstance(x, Node) and not x.cut]
    return found, threshold


def _boilerplate(node: Node, body: Node, taken: bool) -> bool:
    """Whether a node with names of boilerplate is left out: outside the content always, inside it by class or density."""
    if not taken:
        return True
    if node.tag not in BLOCK and node.weight:
        return False
    return node.sure and not node.weight or node.link_chars * 3 > node.chars or node.chars * (body.tags or 1) < body.chars * (node.tags or 1) * LEAST


def blocks(body: Node, found: set[Node], threshold: float) -> list[str]:
    """Text of the nodes found, and text runs no less dense than the threshold between them; a line for each block."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if text := " ".join(entities.unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    ways: set[Node] = set()  # what the nodes found stand in
    for node in found:
        while (node := node.parent) is not None and node not in ways:
            ways.add(node)
    stack: list = [(body, False, False)]
    while stack:
        item, ended, taken = stack.pop()
        if isinstance(item, str):
            line.append(item)
        elif ended:
            close()
        elif not item.cut and not (item.link_chars * 2 > item.chars and item.density < threshold and item.tag in ("ul", "ol", "div", "section", "table", "dl")):
            taken = taken or item in found
            if item.weight < 1 and item not in ways and item not in found and _boilerplate(item, body, taken):
                continue
            if item.tag in BLOCK:
                close()
                stack.append((item, True, taken))
            elif item.tag == "br":
                line.append(" ")
            run = taken or item.run_density >= threshold
            for x in reversed(item.items):
                if isinstance(x, str):
                    if run:
                        stack.append((x, False, taken))
                elif x.tag in BLOCK or x.holds:
                    stack.append((x, False, taken))
                elif run:
                    stack.append((x, False, True))
                elif x in found:
                    stack.append((x, False, True))
    close()
    return out


def extract(page: str) -> str:
    """The main text of one page, a line for each block."""
    if not page:
        return ""
    body = measure(parse(page))
    return "\n".join(blocks(body, *content(body)))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points for every page."""

    def run(batches):
        for b in batches:
            text = [extract(h or "") for h in b["html"].to_pylist()]
            yield batch(_OUT, b["page_id"], b["url"], text, [len(t) for t in text])

    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, SCHEMA)
