"""Main text of web pages, without what a site repeats on its pages.

Method: pages are parsed into trees of elements.  The subtrees of a page are hashed (tags, classes and text), the
pages of each host that hold a hash are counted in Spark, and subtrees found on many pages of their
host are deleted.  Elements whose role is plain from their tag, role or class (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments) go as well.  Of what is left the article is taken,
or the body where there is none.

Prose inside an article (paragraphs, headings, list items and the like, and what holds them) is never taken for a template, however
often it occurs: a site that prints a text twice has two articles.  A subtree is a template if it occurs on at least ``LEAST_PAGES`` pages
and a ``SHARE`` of its host's pages.

Cases: null or empty html has the empty text.  Character references are decoded; white space inside a block becomes one
space; blocks are joined by an empty line.  A null url is a host of its own.  Repeated page rows count as pages.  Very long
pages are read whole.  Hosts with many pages are counted by pre-aggregation and never gathered.  An empty table gives an empty result; only
the page, its url and the kept columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.common import as_text, map_batches, only, written

LEAST_PAGES, SHARE = 5, 0.2
#: Templates and hosts that are shipped to every task at most; more are joined to the pages' hashes by a shuffle.
MOST_SHIPPED = 200_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button".split())
_ASIDE = frozenset("nav footer aside form menu dialog".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
_BLOCKS = _PROSE | frozenset(
    "html body article section main div header footer nav aside form ul ol dl table thead tbody tfoot tr figure hr address "
    "fieldset details summary menu dialog".split()
)
#: Elements that can be templates.
_TEMPLATES = _BLOCKS - frozenset(("html", "body", "article", "main"))
#: A paragraph ends where one of these begins.
_ENDS_P = _BLOCKS - frozenset("td th thead tbody tfoot tr caption html body".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
_CLASSES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|"
    r"footer|header|masthead|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|signup|share|social|related|"
    r"comment|comments|commentlist|disqus\w*|reader-comments|widget\w*)(?:$|[\s_-])",
    re.I,
)


class Node:
    __slots__ = ("tag", "names", "role", "children")

    def __init__(self, tag: str, names: str = "", role: str = "") -> None:
        self.tag, self.names, self.role, self.children = tag, names, role, []


class _Tree(HTMLParser):
    """Elements and texts of a page, with the ends of paragraphs and list items that HTML lets authors leave out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_P:
            self._close({"p"}, _BLOCKS - {"p"})
        if tag in _CLOSES:
            self._close(_CLOSES[tag], {"ul", "ol", "dl", "table"})
        found = dict(attrs)
        node = Node(tag, f"{found.get('class') or ''} {found.get('id') or ''}".strip(), (found.get("role") or "").lower())
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag:
            self.open.pop()

    def _close(self, tags: set[str], barriers: Iterable[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in barriers:
                return

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if tag not in _BLOCKS and self.open[i].tag in _BLOCKS:
                return  # an inline end does not end a block

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _is_aside(node: Node, in_article: bool) -> bool:
    if node.tag in _UNSEEN or node.tag in _ASIDE or node.role in _ROLES:
        return True
    if node.tag == "header" and not in_article:
        return True
    return bool(node.names) and node.tag not in ("html", "body", "article", "main") and bool(_CLASSES.search(node.names))


def subtree_hashes(root: Node) -> dict[int, int]:
    """Hash of tags, classes and text of block elements outside an article, and of those inside without prose; by id().

    Inline elements belong to the text around them and are no templates of their own.
    """
    hashes: dict[int, int] = {}
    done: dict[int, str] = {}
    prose: set[int] = set()
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while stack:
        node, in_article, ready = stack.pop()
        inside = in_article or node.tag in ("article", "main")
        if not ready:
            stack.append((node, in_article, True))
            stack += [(c, inside, False) for c in node.children if isinstance(c, Node)]
            continue
        inner = "".join(f"\1{done[id(c)]}" if isinstance(c, Node) else " ".join(c.split()) for c in node.children)
        digest = xxhash.xxh3_64_intdigest(f"{node.tag}\2{node.names}\2{inner}")
        done[id(node)] = f"{digest:x}"
        if node.tag in _PROSE or any(id(c) in prose for c in node.children if isinstance(c, Node)):
            prose.add(id(node))
        if node.tag in _TEMPLATES and not (in_article and id(node) in prose):
            if inner.strip():
                hashes[id(node)] = digest - (1 << 64) if digest >> 63 else digest
    return hashes


def main_text(root: Node, templates: set[int], hashes: dict[int, int]) -> str:
    """Blocks of the article (of all articles in page order, or of the body), joined by an empty line."""
    articles: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "article":
            articles.append(node)
        elif node is root or not _is_aside(node, False):
            stack += reversed([c for c in node.children if isinstance(c, Node)])
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            blocks.append(text)

    for start in articles or [root]:
        walk: list[Node | str | None] = [start]
        while walk:
            item = walk.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                words.append(item)
            elif item is not start and (_is_aside(item, bool(articles)) or hashes.get(id(item)) in templates):
                flush() if item.tag in _BLOCKS else words.append(" ")
            elif item.tag == "br":
                words.append(" ")
            else:
                if item.tag in _BLOCKS:
                    flush()
                    walk.append(None)
                walk += reversed(item.children)
        flush()
    return "\n\n".join(blocks)


def host_of(url: str) -> F.Column:
    """Host in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_hashes(pages: DataFrame, html: str, host: str) -> DataFrame:
    """Distinct subtree hashes of every page with its host; pre-counted per batch of pages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, counts = batch.slice(start, 256), {}
                for site, value in zip(part.column(0).to_pylist(), as_text(part.column(1))):
                    for h in set(subtree_hashes(parse(value)).values()) if value else ():
                        counts[site, h] = counts.get((site, h), 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int64()),
                     pa.array(list(counts.values()), pa.int64())], names=["host", "hash", "n"]
                )

    return pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, hash long, n long")


def templates(pages: DataFrame, html: str, host: str, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, hash) of the subtrees that many of the host's pages hold."""
    counted = page_hashes(pages, html, host).groupBy("host", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    sites = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    return counted.join(sites, "host").where(F.col("n") >= share * F.col("pages")).select("host", "hash")


def extract(
    pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url"),
    most_shipped: int = MOST_SHIPPED,
) -> DataFrame:
    """Columns ``keep`` and the main ``text`` of every page."""
    chosen = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = pages.select(*chosen, F.col(f"`{html}`").alias("html"), F.col(f"`{url}`").alias("url"))
    rows = rows.withColumn("host", host_of("url")).drop("url")
    found = written(templates(rows, "html", "host"), "templates")
    if found.count() <= most_shipped:
        by_host: dict[str, set[int]] = {}
        for r in found.collect():  # at most most_shipped
            by_host.setdefault(r["host"], set()).add(r["hash"])
        shared = rows.sparkSession.sparkContext.broadcast(by_host)
        lists = None
    else:
        # A host has few templates (each is on a fifth of its pages), so a host's list stays short.
        shared = None
        lists = found.groupBy("host").agg(F.collect_list("hash").alias("hashes"))
        rows = rows.join(lists, "host", "left")
    n = len(keep)
    columns = [*[f"k{i}" for i in range(n)], "html", "host", *(["hashes"] if lists is not None else [])]
    names = [*only(pages, *keep).schema.fields, T.StructField("text", T.StringType())]

    def make():
        def step(batch: pa.RecordBatch):
            sites = batch.column(n + 1).to_pylist()
            own = batch.column(n + 2).to_pylist() if shared is None else [shared.value.get(s, ()) for s in sites]
            texts = []
            for value, known in zip(as_text(batch.column(n)), own):
                root = parse(value)
                known = set(known or ())
                texts.append(main_text(root, known, subtree_hashes(root) if known else {}))
            return [*batch.columns[:n], texts]

        return step

    return map_batches(rows.select(*columns), T.StructType(names), make)
