"""Main text of web pages by composite text density.

The page is parsed into a tree with the implied end tags of HTML. Each node has
its characters, link characters, tags and link tags; its composite density is
the link-adjusted characters per tag, and a node's density sum is the sum over
its children. The threshold is the least density on the path from the node of the
largest sum to the body; from the body down, the subtrees of the largest sum in the
nodes that reach it are the main content, joined in page order. No element is main
content by its tag: density alone decides. What is no content by its element, or by a
class or id that as a whole names such a part, is left out first.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ship

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg".split())
#: Elements whose text is never content.
DROPPED = frozenset("head script style noscript iframe template svg nav footer aside form button select option textarea input dialog object embed canvas audio video map title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body legend summary li dd dt".split())
#: Words of id, class or role that name parts around the article, and those that may stand beside them in such a name.
PART = r"ads?|advert(?:s|isements?|ising)?|sponsor(?:s|ed|ship)?|promo(?:s|tions?|ted)?|banners?|cookies?|consent|gdpr|notices?|popups?|modals?|newsletters?|subscri(?:be|bers?|ptions?)|signup|menus?|nav|navigation|breadcrumbs?|sidebars?|side|widgets?|footers?|headers?|masthead|comments?|disqus|respon(?:ses?|d)|repl(?:y|ies)|social|shar(?:e|es|ing)|related|recommend(?:s|ed|ations?)?|pagination|pager|login|search|toolbars?|copyright|legal|disclaimers?|alerts?|skip|hidden|complementary|contentinfo"
BESIDE = r"left|right|top|bottom|main|site|page|global|primary|secondary|post|posts|article|articles|entry|blog|user|container|wrapper|wrap|box|block|area|section|list|lists|links?|items?|bars?|buttons?|btn|icons?|media|form|forms|slot|unit|panel|inner|outer|body|content|to|this|us|the|stories|news|text|overlay|dialog|thread|count|meta|policy|group|row|column|col|small|large|sticky|fixed|leaderboard|mpu|google|tabs|pills|is|visually"
NAME = re.compile(rf"(?:{PART})(?:{BESIDE}|{PART})?|adsbygoogle")
OTHER = re.compile(rf"{BESIDE}|..?|[0-9x]+")
#: Names that end in one of these are parts whatever stands before.
LAST = re.compile(r"ads?|advert(?:s|isements?|ising)?|nav|navbar|navigation|breadcrumbs?|sidebar|footer|comments|newsletter|pagination|menu|banner|notice|popup|modal|widget")
#: What a name with one of these says is of the page, not of the part.
MODIFIER = frozenset("has no with without not non show by free".split())
#: Words of names that may as well say what a passage of the article is about.
SUBJECT = re.compile(r"notices?|social|shar(?:e|es|ing)|related|recommend(?:s|ed|ations?)?|login|search|copyright|legal|disclaimers?|alerts?|respon(?:ses?|d)|promo(?:s|tions?|ted)?|headers?|masthead|menus?|side|skip|subscri(?:be|bers?|ptions?)|signup|toolbars?|consent|widgets?")
HEADING = re.compile("h[1-6]")
#: So much text without links reads as prose.
PROSE = 80
ABOUT_COMMENTS = re.compile(r"comments?|disqus|repl(?:y|ies)|respon(?:ses?|d)")
WORD = re.compile(r"[^\W_]+")
NEUTRAL = frozenset("html body main article".split())
SCOPE = frozenset("table td th ul ol article section div body html button object".split())
SPACE = re.compile(r"[\s ]+")
INLINE_BREAKS = frozenset(("br",))


class Node:
    __slots__ = ("tag", "attrs", "kids", "dropped", "chars", "links", "tags", "link_tags", "sum", "density")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.dropped = False
        self.chars = self.links = self.tags = self.link_tags = 0
        self.sum = self.density = 0.0


def names_part(name: str) -> bool:
    """Whether a class, id, role or label as a whole names a part around the article."""
    words = WORD.findall(name)
    if not words or not MODIFIER.isdisjoint(words) or (words[0] == "hidden" and len(words) > 1):
        return False
    return LAST.fullmatch(words[-1]) is not None or (any(NAME.fullmatch(w) for w in words) and all(NAME.fullmatch(w) or OTHER.fullmatch(w) for w in words))


def values(node: Node) -> Iterator[tuple[str, str]]:
    for m in ATTR.finditer(node.attrs.lower()):
        yield m[1], m[2] or m[3] or m[4] or ""


def part_names(node: Node) -> list[str]:
    """The names of an element that make it a part around the article."""
    found = []
    for name, value in values(node) if node.attrs else ():
        if name in ("class", "id", "role", "aria-label"):
            found += [x for x in ([value] if name == "aria-label" else value.split()) if names_part(x)]
    return found


def never_shown(node: Node, inside: bool) -> bool:
    """Left out by its element or as hidden, whatever it holds; inside: of an article or main element, whose header
    belongs to it."""
    if node.tag in DROPPED or (node.tag == "header" and not inside):
        return True
    if not node.attrs or node.tag in NEUTRAL:
        return False
    return any(n == "hidden" or (n == "aria-hidden" and v == "true") or (n == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)) for n, v in values(node))


def drop_parts(root: Node) -> None:
    """Marks what is no content.

    By its name alone no heading goes, nothing that holds an article or main element (nor, inside of one or of the
    container of most text, an h1), and, in a page without an article outside of it, nothing that holds most of the
    text. Reader comments go if other prose is left. Names that may be a subject drop no prose from the container or
    article that it lies in. A menu element goes if half of its text is links.
    """
    order: list[tuple[Node, Node | None, bool]] = []
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while todo:
        node, parent, inside = todo.pop()
        node.dropped = (parent is not None and parent.dropped) or never_shown(node, inside)
        order.append((node, parent, inside))
        inside = inside or node.tag in ("article", "main")
        todo.extend((k, node, inside) for k in reversed(node.kids) if not isinstance(k, str))
    names = {id(n): found for n, _, _ in order if not n.dropped and n.tag not in NEUTRAL and not HEADING.fullmatch(n.tag) and (found := part_names(n) or ["menu"] * (n.tag == "menu"))}
    if not names:
        return
    # of each node: characters, those in links, article elements without such a name, whether it holds an h1, its longest text outside of links and named parts
    facts = {id(n): [0, 0, 0, False, 0] for n, _, _ in order}
    for node, parent, _ in reversed(order):
        if node.dropped:
            continue
        f = facts[id(node)]
        text = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        f[0] += text
        f[1] = f[0] if node.tag == "a" else f[1]
        f[2] += node.tag in ("article", "main") and f[0] > 0 and id(node) not in names
        f[3] |= node.tag == "h1"
        f[4] = 0 if node.tag == "a" or id(node) in names else max(f[4], text)
        if parent is not None:
            up = facts[id(parent)]
            up[:4] = up[0] + f[0], up[1] + f[1], up[2] + f[2], up[3] or f[3]
            up[4] = max(up[4], f[4])
    size, _, articles, _, prose = facts[id(root)]
    holder: set[int] = set()
    for node, parent, inside in order:
        if parent is not None and parent.dropped:
            node.dropped = True
        if node.dropped:
            continue
        own, links, held, titled, _ = facts[id(node)]
        inside = inside or id(parent) in holder
        if id(parent) in holder or (2 * own > size and node.tag not in ("html", "body")):
            holder.add(id(node))
        found = names.get(id(node))
        if not found:
            continue
        if node.tag == "menu" and found == ["menu"]:
            node.dropped = 2 * links >= own
        elif any(ABOUT_COMMENTS.search(x) for x in found):
            node.dropped = 2 * prose >= PROSE or 2 * own <= size
        elif not held and (articles or 2 * own <= size):
            about = own - links >= PROSE and 3 * links < own and all(SUBJECT.fullmatch(w) or OTHER.fullmatch(w) for x in found for w in WORD.findall(x))
            node.dropped = not inside or not (titled or about)


def parse(page: str) -> Node:
    """The tree; text is kept as strings among the kids. Iterative, so depth is no limit."""
    root = Node("html")
    body: Node | None = None
    stack = [root]
    at, n = 0, len(page)

    def close(tag: str, stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].kids.append(page[at:lt])
        if lt == n:
            break
        m = TOKEN.match(page, lt)
        if not m:
            # a tag that the end of the page cuts off is markup; any other < is text
            if re.match(r"</?[A-Za-z]|<!", page[lt : lt + 3]) and page.find(">", lt) < 0:
                break
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            if tag not in VOID and tag not in ("body", "html"):
                close(tag, frozenset() if tag in BLOCK else frozenset(("td", "th", "table", "article", "section", "div")))
            continue
        attrs = m[3]
        if tag == "html":
            continue
        if tag == "body":
            if body is None:
                del stack[1:]
                body = Node("body", attrs)
                root.kids.append(body)
                stack.append(body)
            continue
        if tag in CLOSES_P:
            close("p", SCOPE)
        if tag == "li":
            close("li", frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            close("dt", frozenset(("dl",)))
            close("dd", frozenset(("dl",)))
        elif tag in ("td", "th"):
            close("td", frozenset(("table", "tr")))
            close("th", frozenset(("table", "tr")))
        elif tag == "tr":
            close("tr", frozenset(("table",)))
        elif tag == "option":
            close("option", frozenset(("select",)))
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in RAW:
            if attrs.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.kids.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def measure(root: Node) -> list[tuple[Node, Node | None]]:
    """Counts and densities of all nodes in the order of the page, with their parents."""
    drop_parts(root)
    order: list[tuple[Node, Node | None]] = []
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while todo:
        node, parent, in_link = todo.pop()
        order.append((node, parent))
        in_link = in_link or node.tag == "a"
        for kid in node.kids:
            if isinstance(kid, str):
                if not node.dropped:
                    size = len(kid.strip())
                    node.chars += size
                    node.links += size * in_link
        for kid in reversed(node.kids):
            if not isinstance(kid, str):
                todo.append((kid, node, in_link))
    for node, parent in reversed(order):
        if parent is not None and not node.dropped:
            parent.chars += node.chars
            parent.links += node.links
            parent.tags += node.tags + 1
            parent.link_tags += node.link_tags + (node.tag == "a")
    top = max(root.chars, 1)
    ratio = root.links / top
    for node, _ in order:
        if node.dropped or not node.chars:
            continue
        tags, links, plain = max(node.tags, 1), max(node.links, 1), max(node.chars - node.links, 1)
        base = math.log(node.chars / plain * links + ratio * node.chars + math.e)
        adjusted = (node.chars / links) * (tags / max(node.link_tags, 1))
        node.density = node.chars / tags * math.log(max(adjusted, 1.0 + 1e-9)) / math.log(max(base, 1.0 + 1e-9) + 1)
    for node, parent in order:
        if parent is not None and not node.dropped:
            parent.sum += node.density
    return order


def marked(top: Node, order: list[tuple[Node, Node | None]], threshold: float) -> list[Node]:
    """From top down, the maximum-sum subtree of every node whose density is at least the threshold.

    There is no descent below a node under the threshold.
    """
    place = {id(n): k for k, (n, _) in enumerate(order)}
    parents = {id(n): p for n, p in order}
    most: dict[int, Node] = {}
    rank = lambda n: (n.sum, n.chars, -place[id(n)])
    for node, _ in reversed(order):
        if not node.dropped and node.chars:
            most[id(node)] = max([node, *(most[id(k)] for k in node.kids if not isinstance(k, str) and id(k) in most)], key=rank)
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        if id(node) not in most or node.density < threshold:
            continue
        best = most[id(node)]
        # a line is never split
        while best.tag not in BLOCK and parents[id(best)] is not None:
            best = parents[id(best)]
        out.append(best)
        if best is not node:
            todo.extend(k for k in node.kids if not isinstance(k, str))
    return out


def main_nodes(root: Node) -> list[Node]:
    """The main content in page order: maximum-sum subtrees, under the threshold of the path from the body.

    The threshold is the least density on the path from the densest-sum node up to the body;
    every node that reaches it, from the body down, gives its maximum-sum subtree. Headings
    right before what is kept belong to it.
    """
    order = measure(root)
    parents = {id(n): p for n, p in order}
    alive = [n for n, _ in order if not n.dropped and n.chars]
    if not alive:
        return []
    best = max(alive, key=lambda n: (n.sum, n.chars))
    top: Node | None = best
    while top is not None and top.tag != "body":
        top = parents[id(top)]
    top = top or root
    threshold, node = best.density, best
    while node is not top:
        node = parents[id(node)]
        threshold = min(threshold, node.density)
    # one paragraph is no article: its container is
    while parents[id(best)] is not None and (best.tag not in BLOCK or best.tag in ("p", "li", "td", "tr", "blockquote", "pre") or HEADING.fullmatch(best.tag)):
        best = parents[id(best)]
    return whole([best, *marked(top, order, threshold)], order)


def whole(parts: list[Node], order: list[tuple[Node, Node | None]]) -> list[Node]:
    """The parts in page order, each text once, and the headings right before them (an h1 also before left-out parts)."""
    own, kept, out = {id(p) for p in parts}, set(), []
    for node, parent in order:
        if parent is not None and id(parent) in kept:
            kept.add(id(node))
        elif id(node) in own:
            kept.add(id(node))
            out.append(node)
    within, parents = {id(p) for p in out}, {id(n): p for n, p in order}
    heads: list[Node] = []
    waiting: list[Node] = []
    todo: list[Node | str] = [order[0][0]]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                waiting.clear()
        elif id(x) in within:
            heads += waiting
            waiting.clear()
        elif x.dropped:
            if not parents[id(x)].dropped and x.tag not in ("head", "script", "style", "noscript", "template"):
                waiting = [h for h in waiting if h.tag == "h1"]
        elif HEADING.fullmatch(x.tag) and x.chars:
            waiting.append(x)
        else:
            todo.extend(reversed(x.kids))
    own = within | {id(h) for h in heads}
    return [n for n, _ in order if id(n) in own]


def text_of(node: Node) -> str:
    """Blocks in page order, one a line."""
    lines: list[str] = []
    run: list[str] = []

    def flush() -> None:
        s = SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if s:
            lines.append(s)

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.dropped:
            if x.tag in INLINE_BREAKS or x.tag == "hr":
                run.append(" ")
            block = x.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return "\n".join(lines)


def extract(page: str | None) -> str:
    """The main text of a page; empty for null, empty or text-less pages."""
    if not page:
        return ""
    return "\n".join(t for n in main_nodes(parse(page)) if (t := text_of(n)))


def extract_all(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without content, give an empty text. Repeated rows
    get equal results; other columns are ignored.
    """
    ship(pages.sparkSession)
    schema = StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                x = batch.slice(at, 500)
                out = [extract(p.as_py()) for p in x.column("html")]
                yield pa.RecordBatch.from_arrays([x.column("page_id"), x.column("url"), pa.array(out, pa.string()), pa.array([len(s) for s in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
