"""Main text by composite text density.

The page becomes a tree of blocks (inline tags count as tags of their block).  A node's density is its
characters per tag, adjusted by how much of it is link text; a node's density sum adds up its children's.
The node with the greatest sum is the article; the least density on its way up to ``body`` is the
threshold by which further subtrees are let in, down to single blocks and the text that a block has of its own.
Where the article's node stands in an ``article``, that is taken whole; a heading goes with the text after it.  Scripts, styles, forms, menus, headers, footers, sidebars,
notices, adverts and reader comments are known by tag, role, class or id and never count.

Null and empty pages, and pages without text, give the empty string; broken or unclosed markup is read as
browsers would close it; pages are judged one by one, so ties within a page go to the earlier node, and repeated
rows, an empty table and other columns do no harm.
"""

from __future__ import annotations

import math
import re
from html import unescape
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("aside button canvas datalist dialog footer form frameset head iframe input menu nav noframes noscript object script select style svg template textarea title".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
DROPPED_NAMES = frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related respond share sharing "
    "sidebar sidenav social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Names and tags that drop a node only outside of the article itself.
OUTSIDE = frozenset("header masthead banner topbar".split())
#: Words that say only where a named part stands: ``site-footer`` is a footer, ``has-sidebar`` is no sidebar.
PLACES = frozenset("area bar block bottom box button buttons container global inner left link links list main outer page post posts primary right section secondary site top wrap wrapper".split())
COMMENTS = frozenset("comment comments disqus respond".split())
#: What a start tag closes if it is open in the same container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_NAME = re.compile("[a-z0-9]+")


class Node:
    __slots__ = ("articles", "free", "kids", "main", "names", "parent", "role", "tag", "text")

    def __init__(self, tag, parent=None, names=frozenset(), role=""):
        self.tag, self.parent, self.names, self.role, self.kids = tag, parent, names, role, []
        self.articles = self.free = self.main = False
        self.text = 0


#: A start tag's inside, piece by piece.
_TAG = re.compile(r"[^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
#: Elements whose content is text up to their own end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in "iframe noembed noframes script style textarea title xmp".split()}
_NUMBER = re.compile(r"&#(?:([xX])0*([0-9a-fA-F]+)|0*([0-9]+));?")


def decoded(text: str) -> str:
    """Character references replaced; numbers beyond all characters, however long, are the replacement character."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _NUMBER.sub(lambda m: m[0] if len(m[2] or m[3]) < 8 else "\ufffd", text)
    return unescape(text)


class Tree:
    """Open elements are a stack, with the depths at which each tag is open: closing takes no walk.  The page is cut into tags and
    texts in one pass that never looks at a place again: what is not there any more (a further ``>``, a further quote) is
    remembered.  Both are linear in the page's length, whatever it leaves open.

    A tag that no ``>`` follows is text; a quote that is not closed is a part of the value; a comment or script that is
    not closed reaches to the end."""

    def __init__(self):
        self.root = Node("body")
        self.stack, self.open = [self.root], {}

    def feed(self, page: str) -> None:
        n, i = len(page), 0
        last = page.rfind(">")
        ends = {q: page.rfind(q) for q in "\"'"}
        text = 0
        while True:
            i = page.find("<", i)
            if i < 0 or i >= last:
                break
            c = page[i + 1]
            if c.isascii() and c.isalpha():
                self._text(page[text:i])
                i = text = self._start(page, i + 1, ends)
            elif c == "/":
                self._text(page[text:i])
                m = _TAG.match(page, i + 2)
                i = text = page.find(">", m.end()) + 1
                if m[0][:1].isascii() and m[0][:1].isalpha():
                    self.handle_endtag(m[0].lower())
            elif page.startswith("!--", i + 1):
                self._text(page[text:i])
                if page.startswith((">", "->"), i + 4):
                    i = text = page.find(">", i) + 1
                else:
                    stop = page.find("-->", i + 4)
                    i = text = n if stop < 0 else stop + 3
            elif c in "!?":
                self._text(page[text:i])
                i = text = page.find(">", i) + 1
            else:
                i += 1
        self._text(page[text:])

    def _text(self, data: str) -> None:
        if data:
            self.stack[-1].kids.append(decoded(data))

    def _start(self, page: str, i: int, ends: dict[str, int]) -> int:
        """Reads the start tag whose name begins at i; where it ends."""
        m = _TAG.match(page, i)
        tag, i, attrs, closed = m[0].lower(), m.end(), {}, False
        while i < len(page):
            gap = _GAP.match(page, i)
            i = gap.end()
            if i >= len(page) or page[i] == ">":
                closed = gap[0].endswith("/")
                break
            name = _ATTRIBUTE.match(page, i)
            i, value = name.end(), ""
            if eq := _EQUALS.match(page, i):
                i = eq.end()
                q = page[i : i + 1]
                if q in ends and q and ends[q] > i:
                    stop = page.find(q, i + 1)
                    value, i = page[i + 1 : stop], stop + 1
                else:
                    bare = _BARE.match(page, i)
                    value, i = bare[0].strip("\"'"), bare.end()
            attrs.setdefault(name[0].lower(), decoded(value))
        self.handle_starttag(tag, attrs)
        if closed and tag not in VOID and self.stack[-1].tag == tag:
            self._down_to(len(self.stack) - 1)
        elif tag in RAW:
            end = RAW[tag].search(page, i + 1)
            stop = end.start() if end else len(page)
            if tag in ("textarea", "title"):
                self._text(page[i + 1 : stop])
            else:
                self.stack[-1].kids.append(page[i + 1 : stop])
            return stop
        return i + 1

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag not in INLINE:
            self._close(("p",), ("table", "button", "div", "section", "article", "blockquote", "li", "td") if tag != "p" else ())
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES[tag])
        node = Node(tag, self.stack[-1], frozenset(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()), attrs.get("role", "").lower())
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def handle_endtag(self, tag):
        if self.open.get(tag):
            self._down_to(self.open[tag][-1])

    def _down_to(self, depth):
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag].pop()

    def _deepest(self, tags):
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _close(self, tags, scopes):
        depth = self._deepest(tags)
        if depth > self._deepest(scopes):
            self._down_to(depth)


def parse(html: str) -> Node:
    t = Tree()
    t.feed(html)
    return t.root


def _named(n: Node, inside: bool) -> frozenset:
    """The words by which a node's class or id drops it; all words of a name must be such words, or places."""
    found = set()
    for name in n.names:
        words = set(_NAME.findall(name))
        if words <= DROPPED_NAMES | PLACES:
            found |= words & DROPPED_NAMES
    return frozenset() if inside and found <= OUTSIDE else frozenset(found)


def _unseen(n: Node, inside: bool) -> bool:
    """Dropped by tag or role, whatever it holds."""
    return n.tag not in ("article", "main") and (n.tag in DROPPED or (n.tag == "header" and not inside) or n.role in DROPPED_ROLES)


def survey(root: Node) -> None:
    """Per node: unlinked characters, whether it holds a main or an article, and whether one that no name drops."""
    order, todo = [], [(root, False, False)]
    while todo:
        n, inside, linked = todo.pop()
        order.append((n, inside))
        linked = linked or n.tag == "a"
        for x in n.kids:
            if isinstance(x, str):
                n.text += 0 if linked else len("".join(x.split()))
            elif not _unseen(x, inside):
                todo.append((x, inside or x.tag in ("article", "main"), linked))
    for n, inside in reversed(order):
        p = n.parent
        if p is not None:
            own = n.tag in ("article", "main")
            p.text += n.text
            p.main = p.main or n.main or n.tag == "main"
            p.articles = p.articles or n.articles or own
            p.free = p.free or own or (n.free and not _named(n, inside))


def _dropped(n: Node, inside: bool, scope: Node) -> bool:
    """A name does not drop a node that holds main, the scope's only articles, or most of its unlinked text;
    the scope is the article, or the last such node, that it stands in."""
    if n.tag in ("article", "main"):
        return False
    if _unseen(n, inside):
        return True
    words = _named(n, inside)
    if not words or n.main:
        return False
    if words & COMMENTS:
        return True
    most = 2 * n.text > scope.text
    return not (most if inside else not scope.free and (n.articles or most))


class _Block:
    __slots__ = ("best", "chars", "density", "end", "kids", "links", "linked", "own", "parent", "start", "sum", "tag", "tags")


def extract(html: str) -> str:
    """Main text of one page."""
    if not html:
        return ""
    # The page in order: text pieces, None at block borders; and the tree of blocks over it.
    pieces: list[str | None] = []
    blocks: list[_Block] = []
    texts: list[tuple[_Block, int]] = []

    def new(parent, tag="body"):
        b = _Block()
        b.tag = tag
        b.parent, b.kids, b.chars, b.tags, b.links, b.linked, b.own, b.start = parent, [], 0, 0, 0, 0, 0, len(pieces)
        blocks.append(b)
        if parent is not None:
            parent.kids.append(b)
        return b

    top = new(None)
    root = parse(html)
    survey(root)
    stack: list[tuple] = [(iter(root.kids), top, False, False, root)]
    while stack:
        kids, block, in_link, inside, scope = stack[-1]
        x = next(kids, stack)
        if x is stack:
            stack.pop()
            if not stack or stack[-1][1] is not block:
                pieces.append(None)
                block.end = len(pieces)
        elif isinstance(x, str):
            n = len("".join(x.split()))
            block.own += n
            if in_link:
                block.linked += n
            texts.append((block, len(pieces)))
            pieces.append(x)
        elif not _dropped(x, inside, scope):
            if x.tag in ("article", "main") or _named(x, inside):
                scope = x
            if x.tag in INLINE:
                block.tags += 1
                block.links += x.tag == "a"
                if x.tag == "br":
                    pieces.append(None)
                stack.append((iter(x.kids), block, in_link or x.tag == "a", inside, scope))
            else:
                pieces.append(None)
                own = new(block, x.tag)
                own.tags = 1
                stack.append((iter(x.kids), own, in_link, inside or x.tag in ("article", "main"), scope))
    unlinked = {}
    for b in blocks:
        b.chars, unlinked[id(b)] = b.own, b.own - b.linked
    for b in reversed(blocks):
        if b.parent is not None:
            for k in ("chars", "tags", "links", "linked"):
                setattr(b.parent, k, getattr(b.parent, k) + getattr(b, k))
    if not top.chars:
        return ""
    share = top.linked / top.chars
    for b in blocks:
        b.density = _density(b.chars, b.linked, b.tags, b.links, share)
    for b in reversed(blocks):
        b.sum = sum(k.density for k in b.kids) + (_density(b.own, 0, 1, 0, share) if b.kids else 0)
        b.best = max([b, *[k.best for k in b.kids]], key=lambda x: x.sum)
    main = top.best
    path, n = [], main
    while n is not None:
        path.append(n)
        n = n.parent
    threshold = min(x.density for x in path)
    # The logarithm grows with a node's size, so single blocks are held against the path by unlinked characters per tag.
    plain = min(x.chars / max(1, x.tags) for x in path)
    article = next((b for b in path if b.tag == "article"), main)
    chosen = {id(b.best): b.best for b in blocks if b.kids and b.density >= threshold and b.best.sum > 0} | {id(article): article}
    chosen |= {id(b): b for b in blocks if not b.kids and b.chars and (b.density >= threshold or (b.chars - b.linked) / max(1, b.tags) >= plain)}
    covers = [0] * (len(pieces) + 1)
    for b in chosen.values():
        covers[b.start] += 1
        covers[b.end] -= 1
    taken = bytearray(n > 0 for n in accumulate(covers[:-1]))
    direct = {id(b) for b in blocks if b.kids and b.own and unlinked[id(b)] >= plain}
    for b, i in texts:
        if id(b) in direct:
            taken[i] = 1
    after = None
    for b in sorted((b for b in blocks if not b.kids and b.chars), key=lambda x: -x.start):
        if b.tag in HEADINGS and after is not None and taken[after.start]:
            scope = b.parent.parent if b.parent.tag in ("header", "hgroup") else b.parent
            if after.start < scope.end:
                taken[b.start : b.end] = b"\1" * (b.end - b.start)
        after = b
    # What is left out stands between blocks, as a border does.
    return " ".join("".join(" " if x is None or not t else x for x, t in zip(pieces, taken, strict=True)).split())


def _density(chars: int, linked: int, tags: int, links: int, share: float) -> float:
    """Composite text density: characters per tag, damped by the logarithm of the links' part."""
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(1, tags), max(1, linked), max(1, links)
    base = math.log(c / max(1, c - linked) * linked + share * c + math.e)
    return c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9) / math.log(base + 1e-9) if base > 1.0001 else c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9) / 1e-4


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(texts):
        found = [extract(t) for t in texts]
        return [found, [len(t) for t in found]]

    return per_text(pages, html, run, "text string, n_chars long", {"page_id": F.col(key).cast("long"), "url": F.col(url)})
