"""Operator 3: main text of web pages by site template removal.

A page is parsed once into a tree; every element subtree gets a Merkle hash of its tag,
class and contents. Spark counts, per host, the pages in which each subtree occurs (a pair
of partial aggregations, so a host with a third of all pages is no hot task). Subtrees that
recur on TEMPLATE_PAGES pages and TEMPLATE_SHARE of the host's pages are its template: at
most (elements a page) / TEMPLATE_SHARE of them per host. The second pass deletes template
subtrees, and reads what is left of the article in page order.

Menus, adverts and footers often differ in their words from page to page and share only their
form. So every element beside the page's main line (from the root down to the element that
no child holds more than half the text of) is also counted per host by its slot: the path of
tags and classes above it, and its shape, which is the hash of its tag, class and the set of
its children's shapes, without texts. A slot that recurs like a template, and holds
SLOT_SHARE of a page's text at most on average, is one too, at levels that the main line
passes on LEVEL_SHARE of the host's pages that have them (so paragraphs beside a long one stay).
Elements that hold an h1, and those inside an article or main, are no slots.

What no count decides (hosts of few pages, elements on few pages) falls back on names: the
article is what is inside ``article`` or ``main``, and elements that their tag, role or class
marks as no article go (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments). ``named=False`` turns this off, so that templates alone decide.

Inside an ``article`` (or ``main``) a subtree must recur on INSIDE_SHARE of the host's pages
and in TEMPLATE_PAGES different articles, unless it is mostly links: copies of one article
on a site and a passage that some articles share are content, not template. Articles differ if one of the AROUND longest texts outside the subtree does.
Headings, list items and table cells inside an article go only with what holds them.

Blocks: white space (as of str.split) becomes one space, blocks join by one space,
character references are decoded; nothing else is dropped or capped.

Defined cases: null or empty html gives an empty text; a null url is the host ''; pages
that repeat give a row each; unclosed and misnested tags close as in HTML; markup without
an end is text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, maybe_broadcast, released, saved, small_batches, table

TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.3
INSIDE_SHARE = 0.5
AROUND = 3
SLOT_SHARE = 0.25
LEVEL_SHARE = 0.8

#: A quote opens a value only after the equals sign; elsewhere in a tag it is a character like others.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|<[!?][^>]*+>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")

#: Elements of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meta link nobr output q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOT_TEXT = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas audio video map menu dialog datalist title".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr tbody table dl figcaption article main body html".split())
#: Parts of an article that recur by themselves without being template.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody figcaption".split())
#: Elements whose strings are never shown.
UNSEEN = frozenset("head script style noscript template title".split())
#: Templates inside articles, slots and levels are other keys than templates outside.
_INSIDE, _SLOT, _LEVEL = 0x2545F4914F6CDD1D, 0x1B03738712FAD5C9, 0x3C6EF372FE94F82A
#: Words of a class, id or role that mark an element as no article.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside menu nav navbar navigation navigational breadcrumb breadcrumbs pagination pager footer header masthead comment comments comentarios commentaires kommentare disqus discussion reply replies "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox toolbar complementary contentinfo skip hidden".split()
)
_CONTENT_WORDS = frozenset("article post entry content story title".split())
#: Class words after which the rest of the class says what a page has or is about, not what the element is.
_MODIFIER = re.compile(r"(?<![a-z0-9])(?:has|with|without|no|tag|category)[-_]\S*", re.I)
#: Words of elements whose articles are never the page's own.
_OTHERS = frozenset("comment comments comentarios commentaires kommentare disqus discussion reply replies related recommended recommendations".split())
_HEADERS = frozenset(("header", "masthead", "banner"))
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}


class Node:
    __slots__ = ("attrs", "children", "hash", "holds", "links", "parent", "seen", "shape", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node | str] = []
        self.hash = self.size = self.links = self.seen = self.shape = 0
        self.holds = False


def parse(source: str) -> Node:
    """The tree of a page; texts are undecoded strings among the children."""
    root = top = Node("#root", None)
    at = 0
    find = _TOKEN.search
    while m := find(source, at):
        if m.start() > at:
            top.children.append(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue  # comment, doctype
        tag = tag.lower()
        if m[1]:
            top = _close(top, tag)
            continue
        top = _imply(top, tag)
        node = Node(tag, top, m[3])
        top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            stop = end.start() if end else len(source)
            if stop > at:
                node.children.append(source[at:stop])
            at = stop
            if end:
                close = source.find(">", stop)
                at = len(source) if close < 0 else close + 1
        elif tag not in VOID and not m[3].endswith("/"):
            top = node
        elif tag not in VOID:
            top = node if tag not in ("path", "circle", "rect", "line", "use", "g") else top
    if at < len(source):
        top.children.append(source[at:])
    return root


def _close(top: Node, tag: str) -> Node:
    node = top
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if tag in INLINE and node.tag not in INLINE:
            return top  # an inline end tag does not leave its block
        node = node.parent
    return top


def _imply(top: Node, tag: str) -> Node:
    """The open element under which a new tag goes, after the ends that it implies."""
    if tag in _CLOSES:
        node = top
        while node.parent is not None and node.tag not in _SCOPE[tag]:
            if node.tag in _CLOSES[tag]:
                return _imply(node.parent, tag)
            node = node.parent
    elif tag not in INLINE and tag not in ("br", "script", "style", "template"):
        node = top
        while node.parent is not None and node.tag not in ("article", "main", "body", "td", "th", "table", "button", "object"):
            if node.tag == "p":
                return node.parent
            node = node.parent
    return top


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(node.attrs)} if node.attrs else {}


def digest(node: Node) -> None:
    """Sets hash, size (code points of text), seen (of shown text), links (those inside anchors) and shape of all subtrees."""
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        parts = [n.tag, attributes(n).get("class", "")]
        size = links = seen = 0
        shapes: set[str] = set()
        for c in n.children:
            if isinstance(c, Node):
                parts.append(str(c.hash))
                size, links, seen = size + c.size, links + c.links, seen + c.seen
                if c.seen:  # inline marks and empty elements are no part of the form
                    shapes.add("" if c.tag in INLINE and c.tag != "a" else str(c.shape))
            elif words := c.split():
                text = " ".join(words)
                parts.append(text)
                size, seen = size + len(text), seen + len(text)
                shapes.add("")
        n.size, n.links, n.seen = size, size if n.tag == "a" else links, 0 if n.tag in UNSEEN else seen
        n.hash = _hash(parts)
        n.shape = _hash([*parts[:2], *sorted(shapes)])


def _hash(parts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _titled(node: Node) -> bool:
    """True for headings and other parts of an article, and for what holds the page's title."""
    if node.tag in PARTS:
        return True
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag == "h1":
            return True
        stack += [c for c in n.children if isinstance(c, Node)]
    return False


def _levels(root: Node) -> Iterator[tuple[int, list[tuple[Node, int]], bool]]:
    """(key of the level, its other elements with their slot keys, whether the main line goes on) down the main line."""
    path = [""]
    n = root
    while n.seen:
        parts = [c for c in n.children if isinstance(c, Node) and c.seen]
        main = max(parts, key=lambda c: c.seen, default=None)
        goes = main is not None and main.seen * 2 > n.seen and main.tag not in INLINE
        yield _hash(path) ^ _LEVEL, [(c, _hash([*path, str(c.shape)]) ^ _SLOT) for c in parts if c is not main and c.tag not in INLINE and not _titled(c)], goes
        if not goes:
            return
        n = main
        path = [str(_hash(path)), n.tag, attributes(n).get("class", "")]


def _slots(root: Node, templates: set[int] | frozenset[int]) -> set[int]:
    """ids of the elements beside the main line whose slot and level are templates."""
    out: set[int] = set()
    for level, others, goes in _levels(root):
        if goes and level in templates:
            out.update(id(c) for c, slot in others if slot in templates)
    return out


def _hidden(node: Node) -> bool:
    attrs = attributes(node)
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def is_marked(node: Node, inside: bool) -> bool:
    """True for elements that are no part of an article by tag, role, class or id; inside: within the article."""
    tag = node.tag
    if tag in NOT_TEXT or tag == "header" and not inside:
        return True
    if not node.attrs or tag in ("html", "body", "main"):
        return False
    attrs = attributes(node)
    if _hidden(node):
        return True
    named = _MODIFIER.sub(" ", re.sub(r"([a-z])([A-Z])", r"\1-\2", attrs.get("class", "") + " " + attrs.get("id", "")))
    words = set(re.split(r"[^a-z0-9]+", f"{named} {attrs.get('role', '')}".lower()))
    hit = words & MARKED
    if node.holds and not inside and not words & _OTHERS:
        return False
    if hit and hit <= _HEADERS and words & _CONTENT_WORDS:
        return False
    return bool(hit)


def _mark_holders(root: Node) -> None:
    """Sets holds of elements that are or hold an article or main and most of the page's text: no class marks them, unless it names comments or other articles."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if isinstance(c, Node) and c.tag not in NOT_TEXT]
    if not any(n.tag in ("article", "main") for n in order):
        return
    sums: dict[int, tuple[int, bool]] = {}
    for n in reversed(order):
        size, has = 0, n.tag in ("article", "main")
        for c in n.children:
            if isinstance(c, str):
                size += len("".join(c.split()))
            elif id(c) in sums:
                size, has = size + sums[id(c)][0], has or sums[id(c)][1]
        sums[id(n)] = size, has
    for n in order:
        size, has = sums[id(n)]
        n.holds = has and size * 2 > sums[id(root)][0]


def article_roots(root: Node) -> list[Node]:
    """The outermost unmarked articles; else mains; else articles that only their class marks; else the whole page."""
    _mark_holders(root)
    found: dict[str, list[Node]] = {"article": [], "main": []}
    only_named: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        kind = "main" if n.tag == "main" or 'role="main"' in n.attrs else n.tag
        if n is not root and is_marked(n, False):
            if n.tag == "article" and not _hidden(n):
                only_named.append(n)
            continue
        if kind in found:
            found[kind].append(n)
            if kind == "article":
                continue
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    mains = [n for n in found["main"] if not any(p in found["main"] for p in _above(n))]
    return found["article"] or mains or only_named or [root]


def _above(node: Node) -> Iterator[Node]:
    while (node := node.parent) is not None:
        yield node


def _deletable(node: Node, protected: bool) -> bool:
    """Whether a template subtree may go: anything outside an article, inside it what is mostly links."""
    if node.tag in ("html", "body", "head", "#root", "article", "main"):
        return False
    return not protected or node.tag not in TEXT_BLOCKS and node.links * 2 > node.size


def _surroundings(article: Node) -> Iterator[tuple[int, int]]:
    """(key, hash of the AROUND longest texts outside it) of an article's subtrees that could be template; texts end at tags."""
    texts: list[str] = []
    spans: list[tuple[Node, int, int]] = []
    stack: list[tuple[Node | str, int]] = [(article, -1)]
    while stack:
        n, start = stack.pop()
        if isinstance(n, str):
            if words := n.split():
                texts.append(" ".join(words))
        elif start >= 0:
            if len(texts) > start:
                spans.append((n, start, len(texts)))
        elif n is article or not is_marked(n, True) and n.tag != "article":
            if n is not article and n.tag not in INLINE and n.tag not in PARTS and n.tag not in ("main", "body"):
                stack.append((n, len(texts)))
            stack += [(c, -1) for c in reversed(n.children)]
    longest = lambda few: sorted(few, key=lambda t: (-len(t), t))[:AROUND]
    before: list[list[str]] = [[]]
    for t in texts:
        before.append(longest([*before[-1], t]))
    after: list[list[str]] = [[]]
    for t in reversed(texts):
        after.append(longest([*after[-1], t]))
    for n, a, b in spans:
        if around := longest(before[a] + after[len(texts) - b]):
            yield n.hash ^ _INSIDE, _hash(around)


def candidates(root: Node) -> set[tuple[int, int | None]]:
    """Keys of a page's subtrees with text that template deletion could remove, and for those inside an article what is around."""
    roots = article_roots(root)
    safe = {id(n) for n in roots if n is not root}
    out: set[tuple[int, int | None]] = set()
    inner = dict(pair for n in roots if n is not root for pair in _surroundings(n))  # a key counts once a page
    out.update(inner.items())
    stack = [(root, False)]
    while stack:
        n, inside = stack.pop()
        inside = inside or id(n) in safe
        if n.size and n.tag not in INLINE and n.tag not in NOT_TEXT and _deletable(n, inside):
            out.add((n.hash, None))
        if n.tag not in NOT_TEXT:
            stack += [(c, inside) for c in n.children if isinstance(c, Node)]
    return out


def counted_slots(root: Node) -> dict[int, float]:
    """Share of the page's text in each slot beside its main line, and for each level whether the line goes on (1 or 0)."""
    out: dict[int, float] = {}
    for level, others, goes in _levels(root):
        out[level] = float(goes)
        if goes:
            for c, slot in others:
                out[slot] = out.get(slot, 0.0) + c.seen / root.seen
    return out


def main_text(root: Node, templates: set[int] | frozenset[int] = frozenset(), named: bool = True) -> str:
    """Text of the article without template subtrees and marked elements; without named, of the page without templates."""
    roots = article_roots(root) if named else [root]
    slots = _slots(root, templates) if templates else set()
    out: list[str] = []
    for top in roots:
        inside = top is not root
        stack: list[Node | str] = [top]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
                continue
            if n is not top:
                if id(n) in slots and not inside or n.hash in templates and _deletable(n, inside):
                    continue
                if inside and n.tag not in PARTS and n.hash ^ _INSIDE in templates:
                    continue
                if not named and n.tag in UNSEEN:
                    continue
                if named and (is_marked(n, inside) or inside and n.tag == "article"):  # an article in an article is a reader's comment
                    continue
            if n.tag not in INLINE:
                out.append(" ")
                stack.append(" ")
            stack += reversed(n.children)
    return " ".join(unescape("".join(out)).split())


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)"


def host_of(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def site_templates(pages: DataFrame) -> DataFrame:
    """(host, templates) from pages (html, host): subtrees recurring across the host's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes, arounds, shares = [], [], [], []
            for source, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(source or "")
                digest(root)
                got, slots = candidates(root), counted_slots(root)
                hosts += [host] * (len(got) + len(slots))
                hashes += [h for h, _ in got] + list(slots)
                arounds += [a for _, a in got] + [None] * len(slots)
                shares += [None] * len(got) + list(slots.values())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(arounds, pa.int64()), pa.array(shares, pa.float64())], ["host", "hash", "around", "share"])

    total = pages.groupBy("host").count().withColumnRenamed("count", "pages").where(F.col("pages") >= TEMPLATE_PAGES)
    found = pages.select("html", "host").mapInArrow(released(run), "host string, hash long, around long, share double").groupBy("host", "hash", "around").agg(F.count("*").alias("n"), F.sum("share").alias("share"))
    found = found.groupBy("host", "hash").agg(F.sum("n").alias("n"), F.count("around").alias("articles"), F.sum("share").alias("share")).where(F.col("n") >= TEMPLATE_PAGES)
    inside, mean = F.col("articles") > 0, F.col("share") / F.col("n")
    # a slot holds little text, a level is passed almost always: their means can't be taken for one another in between
    found = found.where((~inside | (F.col("articles") >= TEMPLATE_PAGES)) & (mean.isNull() | (mean <= SLOT_SHARE) & (mean > 0) | (mean >= LEVEL_SHARE)))
    found = found.join(total, "host").where(F.col("n") >= F.col("pages") * F.when(inside, INSIDE_SHARE).otherwise(TEMPLATE_SHARE))
    return found.groupBy("host").agg(F.collect_list("hash").alias("templates"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    templates = saved(site_templates(rows), "templates")
    size = templates.agg(F.count("*"), F.sum(F.size("templates"))).first()
    wide = maybe_broadcast(templates.withColumnRenamed("host", "of"), BROADCAST_ROWS + 1 if (size[1] or 0) > BROADCAST_ROWS else size[0])
    kinds = [rows.schema[k].dataType.simpleString() for k in ("id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                root = parse(source or "")
                if gone:
                    digest(root)
                texts.append(main_text(root, set(gone or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    joined = rows.join(wide, F.col("host") == F.col("of"), "left").select("id", "url", "html", "templates")
    return joined.mapInArrow(released(run), f"id {kinds[0]}, url {kinds[1]}, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
