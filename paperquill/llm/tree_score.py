"""Main text of web pages by scoring the tree of their elements.

A paragraph passes points, for its length and its commas, to its parent and, in part, to the ancestors above it; the
points of a container are discounted by the share of its text that is in links. The best container is kept, with those
of its siblings that score well or are paragraphs of running text. What navigation, notices, adverts, forms, comments
and the like are is told from element names, ARIA roles and the words of class and id.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import added_schema, small_batches, with_column

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = set("head script style noscript iframe template svg math canvas object embed audio video nav header footer aside button select option textarea input label fieldset menu dialog map title".split())
BLOCKS = set("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS | {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
PARAGRAPHS = {"p", "pre", "blockquote"}
LISTS = set("div section ul ol dl table tbody tr td center".split())
#: An open element of these names ends where a new one of the given names begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog", "toolbar"}
#: Words of class and id that mark what is not the article.
NOT_ARTICLE = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu "
    "modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended related replies respond share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets gdpr disclaimer login alert hidden".split()
)
#: Those of them that mark what readers wrote, however much of it there is.
READERS = set("comment comments commentlist disqus replies respond".split())
ARTICLE = set("article body content entry main post story text page blog column hentry".split())

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
#: What a tag holds up to its end: quotes count behind an equals sign only, and not at all where they don't close.
INSIDE = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "marked", "menu", "weight", "points", "length", "linked", "links", "depth", "block", "ends_p")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, weight: int = 0):
        self.tag, self.parent, self.dropped, self.weight = tag, parent, dropped, weight
        self.marked, self.menu = "", False
        self.children: list = []  # nodes and strings
        self.points, self.length, self.linked, self.links = 0.0, 0, 0, 0
        # depth; that of the nearest block, itself included; the nearest element that a paragraph can't hold, or paragraph
        self.depth = 0 if parent is None else parent.depth + 1
        self.block: int = self.depth if parent is None or tag in BLOCKS else parent.block
        self.ends_p: Node = self if parent is None or tag in CLOSES_P else parent.ends_p


class _Tree:
    """Open elements of a page that is being read: which is innermost, and those of each name, outer ones first."""

    def __init__(self):
        self.root = self.top = Node("html", None)
        self.open: dict[str, list[Node]] = {}

    def add(self, node: Node, stays_open: bool) -> None:
        self.top.children.append(node)
        if stays_open:
            self.top = node
            self.open.setdefault(node.tag, []).append(node)

    def close(self, node: Node) -> None:
        """Close an open element and all within it."""
        while self.top is not node.parent:
            self.open[self.top.tag].pop()
            self.top = self.top.parent

    def innermost(self, *tags: str) -> Node | None:
        """The innermost open element of some names."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), key=lambda n: n.depth, default=None)


def _marks(attributes: str) -> tuple[bool, str, int]:
    """(is it no part of an article, do class and id say so, its weight) from an element's attributes.

    What class and id say is "", "likely" or "readers" (a name that is one of READERS). A name of ARTICLE words alone,
    as in class="post no-comments", outweighs the other names.
    """
    dropped, weight, marked, article = False, 0, "", False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if name in ("class", "id"):
            words = set(WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)))
            if words & ARTICLE:
                weight += 25
            if words & NOT_ARTICLE:
                marked = "readers" if marked == "readers" or READERS & set(value.split()) else "likely"
                weight -= 25
            names = [set(WORDS.findall(x)) for x in value.split()]
            article |= any(x & ARTICLE and not x & NOT_ARTICLE for x in names)
        elif name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            dropped = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            dropped = True
    return dropped, "" if article else marked, weight


def tags(page: str):
    """(text before, name, is it an end tag, attributes, start of what follows) of each tag; the last has no name.

    Comments, declarations and instructions are passed over. A tag that doesn't close is no text either. Time is linear:
    where quotes leave a tag open up to the end of the page, the page's quotes aren't regarded from there on.
    """
    at, text, quotes, last = 0, [], True, page.rfind(">")
    while True:
        i = page.find("<", at)
        text.append(page[at:i] if i >= 0 else page[at:])
        if i < 0:
            break
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else len(page)
        elif page.startswith("<![CDATA[", i):
            end = page.find("]]>", i)
            text.append(html.escape(page[i + 9 : end if end >= 0 else len(page)], False))
            at = end + 3 if end >= 0 else len(page)
        elif page.startswith(("<!", "<?"), i):
            end = page.find(">", i)
            at = end + 1 if end >= 0 else len(page)
        elif m := NAME.match(page, i):
            if i > last:
                break
            end = INSIDE.match(page, m.end()).end() if quotes else page.find(">", m.end())
            if end == len(page):
                quotes, end = False, page.find(">", m.end())
            at = end + 1
            at = (yield "".join(text), m[1].lower(), page[i + 1] == "/", page[m.end() : end], at) or at
            text.clear()
        else:
            text.append("<")
            at = i + 1
    yield "".join(text), "", False, "", len(page)


def parse(page: str) -> Node:
    """The tree of a page; unclosed and wrongly nested elements are closed as browsers do in the common cases."""
    tree, reader, go_on = _Tree(), tags(page), None
    while True:
        text, tag, is_end, attributes, at = reader.send(go_on)
        go_on = None
        if text:
            tree.top.children.append(html.unescape(text))
        if not tag:
            return tree.root
        if is_end:
            node = tree.innermost(tag)
            inline = tag not in BLOCKS and tag not in DROPPED and tag != "form"
            if node is not None and not (inline and node.depth < tree.top.block):  # an inline end tag doesn't close blocks
                tree.close(node)
            elif node is None and tag == "p":
                tree.add(Node("p", tree.top), False)
            continue
        if tag in ("html", "body") and tree.top.tag in ("html", "body", "head"):
            if tree.top is not tree.root:
                outer = tree.top
                while outer.parent is not tree.root:
                    outer = outer.parent
                tree.close(outer)
            if tag == "html":
                continue
        if tag in CLOSES_P and tree.top.ends_p.tag == "p":
            tree.close(tree.top.ends_p)
        if tag in SIBLINGS:
            node = tree.innermost(*SCOPES[tag], *SIBLINGS[tag])
            if node is not None and node.tag in SIBLINGS[tag]:
                tree.close(node)
        dropped, marked, weight = _marks(attributes) if attributes and not attributes.isspace() else (False, "", 0)
        free = tag in ("html", "body", "article", "main")
        node = Node(tag, tree.top, tag in DROPPED or dropped and not free, weight)
        node.marked = "" if free else marked
        tree.add(node, tag not in RAW and tag not in VOID and not (attributes.endswith("/") and tag in ("path", "circle")))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            go_on = end.end() if end else len(page)


def drop_marked(root: Node, marks: bool) -> bool:
    """Drop forms and, with marks, what class and id mark, but for elements that hold most of the page's paragraph text.

    What readers wrote is no part of that text. True if class or id mark anything.
    """
    order, stack = [], [(root, False)]
    held: dict[int, int] = {}
    while stack:
        node, running = stack.pop()
        order.append(node)
        running = running or node.tag in PARAGRAPHS
        for c in node.children:
            if isinstance(c, str):
                held[id(node)] = held.get(id(node), 0) + running * len(SPACE.sub(" ", c).strip())
            elif not c.dropped and c.tag != "a":
                stack.append((c, running))
    for node in reversed(order):
        if node.parent is not None and node.marked != "readers":
            held[id(node.parent)] = held.get(id(node.parent), 0) + held.get(id(node), 0)
    for node in order:
        most = 2 * held.get(id(node), 0) > held.get(id(root), 0)
        if node.tag == "form" and not most or marks and node.marked and (node.marked == "readers" or not most):
            node.dropped = True
        elif node.marked:
            node.weight = max(node.weight, 0)
    return any(node.marked for node in order)


def measure(root: Node) -> list[Node]:
    """Set the text length and the length of linked text of each node; the nodes, children before parents."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_link = stack.pop()
        order.append(node)
        for c in node.children:
            if isinstance(c, str):
                n = len(SPACE.sub(" ", c).strip())
                node.length += n
                node.linked += n * in_link
            elif not c.dropped:
                stack.append((c, in_link or c.tag == "a"))
    order.reverse()
    for node in order:
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.links += node.links + (node.tag == "a")
    for node in order:  # menus that nothing else marks
        node.menu = node.tag in LISTS and node.links > 1 and link_density(node) > 0.6
    return order


def link_density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def own_text(node: Node) -> str:
    """Text of a node without the blocks in it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif not c.dropped and c.tag not in BLOCKS:
            stack.extend(reversed(c.children))
    return SPACE.sub(" ", "".join(out)).strip()


def blocks(nodes: list[Node]) -> list[str]:
    """The text blocks of some subtrees in page order, white space within a block made single spaces."""
    out: list[str] = []
    held: list[str] = []

    def end():
        text = SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append(text)
        held.clear()

    stack: list = list(reversed(nodes))
    while stack:
        c = stack.pop()
        if c is None:
            end()
        elif isinstance(c, str):
            held.append(c)
        elif not c.dropped and not c.menu:
            if c.tag == "br":
                held.append(" ")
            elif c.tag in BLOCKS:
                end()
                stack.append(None)
            stack.extend(reversed(c.children))
    end()
    return out


def extract(page: str | None) -> str:
    """Main text of a page, its blocks joined by line feeds; empty where there is none.

    Class and id are passed over where nothing is left with them.
    """
    if not page:
        return ""
    text, marked = _extract(page, True)
    return text or marked and _extract(page, False)[0] or ""


def _extract(page: str, marks: bool) -> tuple[str, bool]:
    """(main text, does class or id mark anything)."""
    root = parse(page)
    marked = drop_marked(root, marks)
    return _best(root), marked


def _best(root: Node) -> str:
    order = measure(root)
    scored: list[Node] = []
    for node in order:
        if node.dropped or node.menu or node.tag not in BLOCKS or node.parent is None:
            continue
        text = own_text(node)
        if not text or node.tag in ("html", "body", "hr"):
            continue
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)
        points *= 1 - link_density(node)
        holder, share = (node.parent, 1.0) if node.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "dd", "dt", "figcaption") else (node, 1.0)
        for level in range(5):  # the parent has all points, the one above half, then a third of that, ...
            if holder is None:
                break
            if not holder.points:
                scored.append(holder)
            holder.points += points * share
            share = share / 2 if level == 0 else share * level / (level + 1) / 1.5
            holder = holder.parent
    if not scored:
        return "\n".join(blocks([root]))
    value = {id(n): (n.points + n.weight + (25 if n.tag in ("article", "main") else 0)) * (1 - link_density(n)) for n in scored}
    best = max(scored, key=lambda n: value[id(n)])
    # An article or main element above the best container, without another in between, holds the whole article.
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None and not up.dropped:
        best = up
    # Lists of links inside the article are its own; beside running text right in the body they are menus.
    if best.tag not in ("html", "body"):
        stack = [best]
        while stack:
            node = stack.pop()
            node.menu = False
            stack.extend(c for c in node.children if isinstance(c, Node))
    if best.parent is None:
        return "\n".join(blocks([best]))
    least = max(10.0, 0.2 * value[id(best)] if id(best) in value else 10.0)
    kept = []
    for s in best.parent.children:
        if s is best:
            kept.append(s)
        elif isinstance(s, Node) and not s.dropped and not s.menu:
            if value.get(id(s), 0.0) >= least:
                kept.append(s)
            elif s.tag == "p" and best.tag not in ("article", "main"):
                n, density = s.length, link_density(s)
                if n > 80 and density < 0.25 or 0 < n <= 80 and not density and re.search(r"[.!?](\s|$)", own_text(s)):
                    kept.append(s)
    return "\n".join(blocks(kept))


def extract_pages(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """pages with a column that holds the main text of each; a null page gives an empty text.

    Every row gives one row, and other columns pass unchanged; a column that has the output's name is replaced.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            yield with_column(b, out, pa.array([extract(x) for x in b.column(html_column).to_pylist()], pa.string()))

    return pages.mapInArrow(run, added_schema(pages, (out, "string")))
