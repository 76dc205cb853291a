"""Main text of web pages by tree scoring.

The page is read into a tree as browsers do (end tags may be missing, elements may be left open).
Every paragraph gives points, for being one, for its length and for its commas: all of them to its
parent, half to its grandparent, less to the ``LEVELS`` - 2 ancestors above.  Elements that usually hold
articles begin with a bonus.  A container's points are discounted by the share of its text that
stands in links.  The container with the most points is the article; siblings that look like more of
it are kept with it.  If it is in an article or main element, so are the other parts of that one, up
to it: titles, paragraphs, lists and tables, and boxes that have a fair share of the points or, in an
article element, few links; further article elements beside it are kept by their points.  Menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles are taken
out of the tree first, by element and by the words of class, id and role.

Defined results: null, empty and text-free pages give "".  A page whose paragraphs are too short to
score gives its article or main element, else its body.  White space within a block is one space,
blocks are joined by one line feed, and nothing is capped.  Equal pages, and so repeated rows, have
equal texts; of containers with equal points the first in page order is taken.  An empty table gives
an empty result.  All other columns are kept, whatever their names, but for one named as the result.
Cost is linear in the page, however deep it is nested; there is no recursion.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option legend".split())
DROPPED = frozenset(
    "nav aside footer script style noscript template iframe svg math canvas object embed audio video map button select "
    "textarea input label datalist dialog menu head title xmp noembed noframes search fieldset".split()
)
# Words in class, id or role that name what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner "
    "nav navbar navigation navigator menu menubar breadcrumb breadcrumbs pager pagination toc "
    "header hdr masthead topbar toolbar footer ftr bottombar colophon copyright legal "
    "sidebar sidebars rail widget widgets aside complementary contentinfo "
    "notice notices cookie cookies consent gdpr alert alertdialog dialog popup modal overlay paywall disclaimer "
    "comment comments commentlist respond reply replies disqus discussion feedback "
    "form search searchbox login signin signup register subscribe subscription newsletter "
    "share sharing social related recommended recommendations trending popular outbrain taboola skip tags".split()
)
STEMS = ("nav", "menu", "sidebar", "footer", "comment", "cookie", "advert", "banner", "newsletter")  # also as ends of one word
PLAIN_MARKS = frozenset("has with no without is not show hide".split())  # "page-with-sidebar" says where, not what

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_QUOTE = re.compile(r"=\s*([\"'])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p pre blockquote td dd li".split())


#: How many ancestors a paragraph gives points to.
LEVELS = 6
BONUS = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 3.0, "td": 3.0, "blockquote": 3.0}
_FLOW = _HEADINGS | frozenset("p blockquote pre ul ol dl table figure hr".split())
_CELLS = frozenset("td th table".split())
_IN_TABLES = frozenset("table tr tbody thead tfoot td th".split())


class Node:
    """``article`` and ``main``: the nearest such element around it; ``given``: its points without a bonus."""

    __slots__ = ("article", "attrs", "children", "dropped", "given", "linked", "links", "main", "parent", "points", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list = []
        self.article = self.main = None
        if parent is not None:
            self.article = parent if parent.tag == "article" else parent.article
            self.main = parent if parent.tag == "main" else parent.main
        self.dropped, self.points, self.given, self.text, self.linked, self.links = False, 0.0, 0.0, 0, 0, 0

    def named(self) -> dict[str, str]:
        found = {}
        for m in _ATTR.finditer(self.attrs):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        return found


class _Open:
    """The elements that are open, with the places of each kind, so that none is looked for."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, []

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        """The place of the innermost of these; 0 if none is open."""
        return max((found[-1] for found in map(self.places.get, tags) if found), default=0)

    def implied(self, tag: str, stop: int) -> None:
        """A start tag closes the open ``tag``, unless what stops that is further in."""
        place = self.last(tag)
        if place > stop:
            self.cut(place)

    def close(self, tag: str) -> None:
        """An end tag; those of inline elements reach no further than their block, others no further than their cell."""
        place = self.last(tag)
        stop = 0 if tag in BLOCK or not self.blocks else self.blocks[-1]
        if tag not in _IN_TABLES:
            stop = max(stop, self.last(*_CELLS - {tag}))
        if place > stop:
            self.cut(place)


_P_STOPS = ("table", "td", "th", "button", "caption", "object", "template")


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order; the first is the root."""
    root = Node("#root", None)
    nodes, open_, at, end = [root], _Open(root), 0, len(page)
    unclosed = {'"': end + 1, "'": end + 1}  # from here on this quote does not close
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            open_.top.children.append(page[at:lt])
        if lt == end:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                close = page.find("-->", lt + 4)
                at = end if close < 0 else close + 3
            else:
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            continue
        closing = nxt == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            if closing:
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                open_.top.children.append("<")
                at = lt + 1
            continue
        tag, body = name[0].lower(), name.end()
        at = body
        while True:  # to the > that is not inside a quoted value
            gt = page.find(">", at)
            if gt < 0:
                gt = end
                break
            quote = _QUOTE.search(page, at, gt)
            if not quote or quote.start(1) >= unclosed[quote[1]]:
                break
            close = page.find(quote[1], quote.end())
            if close < 0:
                unclosed[quote[1]] = quote.start(1)
                break
            at = close + 1
        attrs, at = page[body:gt], gt + 1
        if closing:
            if tag not in ("html", "body"):
                open_.close(tag)
            continue
        if tag in ("html", "body"):
            if any(n.tag == tag for n in open_.stack[1:3]):
                continue
        elif tag in CLOSES_P:
            open_.implied("p", open_.last(*_P_STOPS))
        if tag == "li":
            open_.implied("li", open_.last("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            open_.implied("dt", open_.last("dl"))
            open_.implied("dd", open_.last("dl"))
        elif tag in ("td", "th"):
            open_.implied("td", open_.last("tr", "table"))
            open_.implied("th", open_.last("tr", "table"))
        elif tag == "tr":
            open_.implied("tr", open_.last("table"))
        elif tag in ("tbody", "thead", "tfoot"):
            for section in ("tbody", "thead", "tfoot"):
                open_.implied(section, open_.last("table"))
        elif tag == "option":
            open_.implied("option", open_.last("select"))
        elif tag in _HEADINGS and open_.top.tag in _HEADINGS:
            open_.cut(len(open_.stack) - 1)
        elif tag == "body":
            open_.implied("head", open_.last(*_P_STOPS))
        elif tag == "a":
            open_.implied("a", open_.blocks[-1] if open_.blocks else 0)
        node = Node(tag, open_.top, attrs)
        nodes.append(node)
        open_.top.children.append(node)
        if tag in VOID or (attrs.endswith("/") and tag in ("svg", "path")):
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            gt = page.find(">", close.end()) if close else -1
            at = end if gt < 0 else gt + 1
            continue
        open_.push(node)
    return nodes


def _marked(node: Node) -> bool:
    """True if class, id or role of the element name something that is not the article."""
    if not node.attrs:
        return False
    named = node.named()
    if "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", "")):
        return True
    if node.tag in ("article", "main", "body", "html") and named.get("role", "") in ("", "main", "article"):
        words = [w.lower() for w in _WORDS.findall(f"{named.get('class', '')} {named.get('id', '')}")]
        return node.tag == "article" and any(w in ("comment", "comments", "reply", "ad", "advert", "sponsored", "promo") for w in words)
    for value in (named.get("class", ""), named.get("id", ""), named.get("role", "")):
        for one in value.split():
            for word in _WORDS.findall(one):
                word = word.lower()
                if word in PLAIN_MARKS:
                    break
                if word in BOILERPLATE or word.endswith(STEMS):
                    return True
    return False


def _inner(nodes: list[Node], found) -> dict[int, int]:
    """How many of the nodes that ``found`` picks are in each node's subtree, itself included."""
    counts = {id(n): int(found(n)) for n in nodes}
    for node in reversed(nodes[1:]):
        counts[id(node.parent)] += counts[id(node)]
    return counts


def _drop(nodes: list[Node]) -> None:
    """Marks what is not the article.

    What is named as boilerplate goes, unless it wraps all articles of the page (those that are not
    named so themselves); where the page has none, unless it wraps its headings.
    """
    marked = {id(n) for n in nodes if n.attrs and _marked(n)}
    titles = _inner(nodes, lambda n: n.tag == "h1")
    held = _inner(nodes, lambda n: n.tag in ("article", "main") and id(n) not in marked)
    if not held[id(nodes[0])]:
        held = titles
    every = held[id(nodes[0])]
    for node in nodes[1:]:
        wraps = every and held[id(node)] == every
        if node.parent.dropped or node.tag in DROPPED:
            node.dropped = True
        elif node.tag == "header":  # an article's own header stays with its title
            node.dropped = not (titles[id(node)] and (node.article or node.main))
        elif node.tag == "form":
            node.dropped = not wraps
        elif id(node) in marked:
            own = titles[id(node)] and node.tag != "article" and (node.article or node.main) and "header" in node.attrs
            node.dropped = not (wraps or own) or "hidden" in node.named()


def _measure(nodes: list[Node]) -> None:
    """text: characters of text without extra white space; linked: those in links; links: the links, dropped ones too."""
    for node in reversed(nodes):
        node.links += node.tag == "a"
        if node.parent is not None:
            node.parent.links += node.links
        if node.dropped:
            continue
        for child in node.children:
            if isinstance(child, str):
                node.text += sum(map(len, child.split()))
            elif not child.dropped:
                node.text += child.text
                node.linked += child.linked
        if node.tag == "a":
            node.linked = node.text


def _own_text(node: Node) -> str:
    """Text of a block without that of blocks inside it."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or not x.dropped and x.tag not in BLOCK:
            todo.extend(reversed(x.children))
    return entities.unescape("".join(out))


def _score(nodes: list[Node]) -> None:
    for node in nodes:
        if node.dropped or node.tag not in BLOCK or node.tag in _HEADINGS or not any(not isinstance(c, str) or not c.isspace() for c in node.children):
            continue
        text = " ".join(_own_text(node).split())
        if len(text) < 25 or node.text and node.linked > 0.8 * node.text:
            continue
        points = 1.0 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3.0)
        up = node.parent if node.tag in _PARAGRAPHS else node
        for level in range(LEVELS):
            if up is None or up.tag == "#root":
                break
            up.given += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = up.parent
    for node in nodes:
        if node.given and node.text:
            node.given *= 1 - node.linked / node.text
            node.points = node.given + BONUS.get(node.tag, 0.0) * (1 - node.linked / node.text)


def _render(tops: list[Node]) -> str:
    """The blocks of these nodes in page order."""
    blocks, now = [], []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            blocks.append(text)
        now.clear()

    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                now.append(x)
            elif x.dropped:
                continue
            elif x.tag == "br":
                now.append(" ")
            elif x is not top and _link_list(x):
                continue
            elif x.tag in BLOCK:
                flush()
                todo.append(None)
                todo.extend(reversed(x.children))
            else:
                todo.extend(reversed(x.children))
        flush()
    return "\n".join(blocks)


def _link_list(node: Node) -> bool:
    """A list or box that is links only, three or more: a menu, not part of the article."""
    return node.tag in ("ul", "ol", "div", "section", "table") and node.text > 0 and node.linked >= 0.9 * node.text and node.links >= 3


def _more(best: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    if best.parent is None or best.tag in ("article", "main", "body"):
        return [best]
    least, kept = max(10.0, 0.2 * best.points), []
    for node in best.parent.children:
        if isinstance(node, str) or node.dropped or not node.text:
            continue
        density = node.linked / node.text
        if node is best or node.points >= least:
            kept.append(node)
        elif node.tag in _HEADINGS:
            if density < 0.5:
                kept.append(node)
        elif node.tag in ("p", "blockquote", "pre") and (node.text > 80 and density < 0.25 or density == 0):
            kept.append(node)
    return kept


def _part(node: Node, most: float, generous: bool) -> bool:
    """True if a child of an article or main element is part of it; ``most``: the most points that it or a child has."""
    density = node.linked / node.text if node.text else 0.0
    if node.tag in _FLOW or node.tag not in BLOCK or node.tag == "header":
        return density < 0.5 or not node.text
    return node.given >= 0.25 * most and density < 0.5 or generous and density < 0.25


def _prune(best: Node, holder: Node) -> None:
    """Drops what is in ``holder`` but not part of the article, on the way from it to ``best``."""
    node, generous = best, holder.tag == "article"
    if best is holder:
        boxes = [c for c in holder.children if not isinstance(c, str) and not c.dropped]
        most = max([holder.given, *(c.given for c in boxes)])
        for child in boxes:
            child.dropped = not _part(child, most, generous)
        return
    while node is not holder:
        for child in node.parent.children:
            if not isinstance(child, str) and child is not node and not child.dropped:
                child.dropped = not _part(child, node.given, generous)
        node = node.parent


def _beside(article: Node) -> list[Node]:
    """The article element and those beside it that have a fair share of its points; in main with its title."""
    if article.parent is None:
        return [article]
    least, kept = max(10.0, 0.2 * article.points), []
    for node in article.parent.children:
        if node is article or not isinstance(node, str) and not node.dropped and (
            node.tag == "article" and node.points >= least or node.tag == "h1" and article.parent.tag == "main"
        ):
            kept.append(node)
    return kept


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    nodes = parse(page)
    _drop(nodes)
    _measure(nodes)
    _score(nodes)
    scored = [n for n in nodes if n.points and not n.dropped]
    if scored:
        best = max(scored, key=lambda n: n.points)
        holder = best if best.tag in ("article", "main") else best.article or best.main
        if holder is None or holder.dropped:
            return _render(_more(best))
        _prune(best, holder)
        return _render(_beside(holder) if holder.tag == "article" else [holder])
    for tags in (("article",), ("main",), ("body",), ("#root",)):
        text = "\n".join(filter(None, (_render([n]) for n in nodes if n.tag in tags and not n.dropped)))
        if text:
            return text
    return ""


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without the html column, with the main text as ``out_col`` (replaced if it exists)."""
    import pyspark.sql.types as T

    own = [f for f in pages.schema.fields if f.name not in (html_col, out_col)]
    inner = [f"c{i}_" for i in range(len(own))]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(len(inner)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(inner)], texts], names=[*inner, "text_"])

    schema = T.StructType([*[T.StructField(n, f.dataType, True) for n, f in zip(inner, own, strict=True)], T.StructField("text_", T.StringType())])
    rows = pages.select(*[F.col(f"`{f.name}`").alias(n) for n, f in zip(inner, own, strict=True)], F.col(f"`{html_col}`").alias("html_"))
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(f.name) for n, f in zip(inner, own, strict=True)], F.col("text_").alias(out_col))
