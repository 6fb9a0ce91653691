"""Main text of web pages by composite text density.

A page becomes a tree (implied end tags are set, unknown end tags passed
over, elements nested over DEEP levels are put beside each other).  Subtrees that
are never article text go first: scripts, styles, forms, menus, footers, asides,
page headers, what is hidden, and elements whose class, id or role says what density
can't see, since it is running text: adverts, notices, sidebars and reader comments
(SIGNS), unless the article itself is inside.  Every node left, texts among them, has
characters and tags, and those of links; its density is characters by tag, adjusted
by the share of links.  The node with the largest sum of its children's densities
is the centre; the least density on its path to the body is the
threshold, and in each branch that reaches it the node with the largest sum
is text, with all it holds but menus (blocks that are mostly links).  Such a node inside
an article, or inside a main element without articles, stands for that whole element:
this widens what density has selected, and nothing in an article goes as a menu.

Blocks end at block-level tags.  Null and empty pages, and pages without
text, give an empty string.  Repeated rows give repeated results.  A page of any
length and nesting takes time in proportion to its length: tags are scanned once,
forwards.  Columns may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow

_words = lambda s: frozenset(s.split())
#: Fixed values of HTML: elements without content, with raw text, and block-level ones.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title xmp iframe noembed noframes noscript template")
BLOCK = _words("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul")
#: A start tag of the key ends open elements of the values, up to the last item.
IMPLIED = {"li": (_words("li"), _words("ul ol menu dir")), "dt": (_words("dt dd"), _words("dl")), "dd": (_words("dt dd"), _words("dl")), "tr": (_words("tr td th"), _words("table")), "td": (_words("td th"), _words("tr table")), "th": (_words("td th"), _words("tr table")), "option": (_words("option"), _words("select")), "tbody": (_words("tbody thead tfoot tr td th"), _words("table"))}
#: Elements that are never article text.
OUT = _words("script style noscript template iframe object embed head title form button select textarea input fieldset nav footer aside menu dialog svg canvas video audio map")
#: Words in class, id or role that say the same of running text.
SIGNS = _words("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert disclaimer popup modal newsletter subscribe subscription sidebar complementary related comment comments replies respond hidden")
DEEP = 512
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_STOP = re.compile("[<>\"']")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "up", "depth", "block", "kids", "out", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, out: bool = False):
        self.tag, self.up, self.out = tag, up, out
        self.depth = up.depth + 1 if up else 0
        #: The nearest block-level element, itself included.
        self.block: Node | None = self if tag in BLOCK or up is None else up.block
        self.kids: list[Node | str] = []


def _marked(attrs: str) -> bool:
    """Whether attributes say that an element isn't article text."""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), unescape(value.strip("\"'"))
        if name in ("class", "id", "role") and any(p.lower() in SIGNS for p in _PART.findall(value)):
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Tags:
    """The tags of a page, from left to right; what isn't there is not looked for again."""

    def __init__(self, html: str):
        self.html, self.gone = html, {}

    def find(self, what: str, start: int) -> int:
        """The next place of `what`, the length if there is none."""
        if start >= self.gone.get(what, len(self.html) + 1):
            return len(self.html)
        at = self.html.find(what, start)
        if at < 0:
            self.gone[what] = start
            return len(self.html)
        return at

    def end(self, start: int) -> int:
        """Where a tag ends whose attributes begin at `start`: at a > (or a <) outside quotes; of an open quote, at the next > at all."""
        at, size = start, len(self.html)
        while m := _STOP.search(self.html, at):
            sign = m[0]
            if sign in "<>":
                return m.start()
            close = self.find(sign, m.end())
            if close == size:
                return self.find(">", start)
            at = close + 1
        return size

    def raw_end(self, name: str, start: int) -> int:
        """Where the raw text that begins at `start` has ended, with its end tag."""
        key = f"</{name}"
        if start < self.gone.get(key, len(self.html) + 1):
            if m := re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(self.html, start):
                return m.end()
            self.gone[key] = start
        return len(self.html)

    def scan(self):
        """(text before it, name or "" for comments and the like, whether it ends an element, attributes, place after it)."""
        html, size, pos = self.html, len(self.html), 0
        text = 0
        while True:
            at = self.find("<", pos)
            if self.find(">", at) == size:
                # no tag can end any more, so the rest is text
                yield html[text:], "", False, "", size
                return
            pos = at + 1
            m = _NAME.match(html, at)
            if m:
                stop = self.end(m.end())
                if stop == size:
                    continue  # never closed: text
                after = stop + (html[stop] == ">")
                skip = yield html[text:at], m[2].lower(), bool(m[1]), html[m.end() : stop], after
            elif html.startswith("<!--", at):
                skip = yield html[text:at], "", False, "", min(size, self.find("-->", at + 4) + 3)
                after = min(size, self.find("-->", at + 4) + 3)
            elif html[at + 1 : at + 2] in ("!", "?", "/") and (stop := self.find(">", at)) < size:
                after = stop + 1
                skip = yield html[text:at], "", False, "", after
            else:
                continue
            text = pos = max(after, skip or 0)


def tree(html: str) -> Node:
    root = Node("#root", None)
    at, count = root, {}
    tags = Tags(html)
    scan, skip = tags.scan(), None
    while True:
        try:
            text, name, closes, attrs, pos = scan.send(skip)
        except StopIteration:
            return root
        skip = None
        if text:
            at.kids.append(unescape(text))
        if not name:
            continue
        if closes:
            if not count.get(name):
                continue
            x = at
            while x is not root and x.tag != name and not (x.tag in ("table", "body") and name not in ("html", "body")):
                x = x.up
            if x is not root and x.tag == name and name not in ("html", "body"):
                at = x.up
            continue
        if name in ("html", "body"):
            x = at
            while x is not root and x.tag != name:
                x = x.up
            if x is not root:
                continue
        if name == "body":
            at = next((k for k in root.kids if isinstance(k, Node) and k.tag == "html"), root)
        if name in BLOCK and at.block.tag == "p":
            at = at.block.up
        ends, bound = IMPLIED.get(name, (None, None))
        if ends:
            x, last = at, None
            while x is not root and x.tag not in bound:
                if x.tag in ends:
                    last = x
                x = x.up
            if last is not None:
                at = last.up
        while at.depth >= DEEP:
            at = at.up
        node = Node(name, at, name in OUT or name not in ("html", "body", "article", "main") and bool(attrs) and _marked(attrs))
        at.kids.append(node)
        if name in RAW:
            low = tags.raw_end(name, pos)
            skip = low
            node.out = True
        elif name not in VOID:
            at = node
            count[name] = count.get(name, 0) + 1


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return out


def _clean(root: Node) -> None:
    order = _walk(root)
    core = set()
    for x in reversed(order):
        if x.tag in ("article", "main", "h1") or any(isinstance(k, Node) and id(k) in core for k in x.kids):
            core.add(id(x))
    for x in order:
        if x.tag == "header" and not x.out:
            y = x.up
            while y is not None and y.tag not in ("article", "main"):
                y = y.up
            x.out = y is None
        if x.out and x.tag not in OUT and x.tag != "header" and id(x) in core:
            x.out = False
    for x in order:
        x.kids = [k for k in x.kids if not (isinstance(k, Node) and k.out)]


def _measure(root: Node) -> None:
    order = _walk(root)
    for x in reversed(order):
        x.chars, x.tags, x.link_chars, x.link_tags = 0, 0, 0, 0
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len("".join(k.split()))
            else:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
    share = root.link_chars / max(1, root.chars)
    for x in order:
        x.density = _density(x.chars, x.tags, x.link_chars, x.link_tags, share)
    for x in order:
        link = x.tag == "a"
        x.total = 0.0
        for k in x.kids:
            if isinstance(k, str):
                n = len("".join(k.split()))
                x.total += _density(n, 0, n if link else 0, 0, share)
            else:
                x.total += k.density


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters by tag, times a logarithm of how few of both are links, to a base that grows with the page's share of links."""
    if not chars:
        return 0.0
    tags, some, linked = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / some * tags / linked)) / math.log(base + 1e-9) if base > 1.000001 else chars / tags * math.log(max(1.0, chars * tags) + 1)


def _blocks(node: Node, keep) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush():
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    stack: list = [(node, 0)]
    while stack:
        x, step = stack.pop()
        if isinstance(x, str):
            line.append(x)
            continue
        block = x.tag in BLOCK
        if step:
            flush()
            continue
        if not keep(x):
            continue
        if x.tag == "br":
            line.append("\n")
            continue
        if block:
            flush()
            stack.append((x, 1))
        stack += [(k, 0) for k in reversed(x.kids)]
    flush()
    return out


def _above(nodes, top: Node) -> set[int]:
    """The ids of all nodes that hold one of these."""
    out: set[int] = set()
    for x in nodes:
        while x is not top and id(x.up) not in out:
            x = x.up
            out.add(id(x))
    return out


def main_text(html: str) -> str:
    root = tree(html)
    _clean(root)
    _measure(root)
    order = _walk(root)
    body = next((x for x in order if x.tag == "body"), root)
    if not body.chars:
        body = root
    if not body.chars:
        return ""
    inner = _walk(body)
    centre = max(inner, key=lambda x: x.total)
    low, x = centre.density, centre
    while x is not body:
        x = x.up
        low = min(low, x.density)
    # every branch that reaches the threshold gives its node with the largest sum, widened to its article,
    # or to a main element without articles; lists of links outside these go
    best: dict[int, Node] = {}
    for x in reversed(inner):
        best[id(x)] = max([x, *(best[id(k)] for k in x.kids if isinstance(k, Node))], key=lambda y: y.total)
    homes: dict[int, Node | None] = {id(body): None}
    split = _above([x for x in inner if x.tag == "article"], body)
    for x in inner:
        if x is not body:
            up = homes[id(x.up)]
            own = x.tag == "article" or x.tag == "main" and id(x) not in split
            homes[id(x)] = x if own and (up is None or up.tag == "main") else up
    marked, whole = {id(homes[id(centre)] or centre)}, [homes[id(centre)]]
    for x in inner:
        if x.chars and x.density >= low:
            y = best[id(x)]
            while y.tag not in BLOCK and y is not body:
                y = y.up
            whole.append(homes[id(y)])
            marked.add(id(homes[id(y)] or y))
    chosen = {id(x): x for x in whole if x is not None}
    over = _above(chosen.values(), body)
    links = lambda x: x.tag in BLOCK and x.link_tags >= 3 and x.link_chars > 0.6 * x.chars and id(x) not in over and id(homes[id(x)]) not in chosen
    out: list[str] = []
    stack = [body]
    while stack:
        x = stack.pop()
        if links(x):
            continue
        if id(x) in marked:
            out += _blocks(x, lambda y: not links(y))
        else:
            stack += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """All columns of pages, and __text."""

    def make():
        return lambda texts: [pa.array([main_text(t.decode()) for t in texts], pa.string())]

    return append_arrow(pages, make, [("__text", T.StringType())], "html")


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))
