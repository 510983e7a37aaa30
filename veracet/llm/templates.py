"""Main text of HTML pages by site template removal.

Every page is parsed to a tree.  The subtrees of all its block elements, in and out of the article, are hashed, and counted
per host in Spark: a subtree that lies on ``LEAST_PAGES`` different pages of a host and on ``LEAST_SHARE`` of them is
the host's template, and is deleted wherever it stands.  Copies of one page count once, as a subtree's pages are told apart by
the hash of the whole article; a passage that fewer articles of a host share is not a template.

What no other page repeats goes by its name or role (scripts, menus, headers, footers, asides, forms), or by a class or id that
is one word of ``_CLASSES`` alone (``class="ad"``; neither ``class="lead notice"`` nor ``id="content-with-sidebar"``).
An article or main element is never dropped by its class, and neither is what stands around a page's first one.

The counts are grouped by (host, subtree), so a host that has a third of all pages is spread over all tasks; its
templates are few, as each lies on ``LEAST_SHARE`` of its pages.

Text: character references are decoded, white space in a block becomes one space, blocks are joined by a line feed.

Defined results: null or empty html has an empty text; a page without markup is its own text; a page without article
or main element is its body; pages without a host are one host; repeated rows are separate pages; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracet.llm.link_trust import host_of
from veracet.llm.store import join_small, written

#: A subtree is a template if it lies on this many different pages of a host at least, and on this share of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.35

# Names and words of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hr address"
    " details summary fieldset legend center nav header footer aside form hgroup menu dialog".split()
)
_DROPPED = frozenset(
    "head nav header footer aside form script style noscript template iframe svg canvas button select option textarea input menu dialog object embed audio video title"
    " math map".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog".split())
_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar comment comments"
    " disqus newsletter subscribe subscription share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation footer header masthead popup"
    " modal overlay pagination pager widget toolbar login signup".split()
)
_UNSEEN = _RAW | frozenset("head template svg math canvas object map".split())
_CLOSES_P = _BLOCK - frozenset("html body li dd dt td th tr thead tbody tfoot caption summary legend figcaption".split())
_HOLDS_P = frozenset("td th table button object".split())
_SIBLINGS = {
    "li": ("li", "ul ol menu".split()), "dt": ("dt dd", ["dl"]), "dd": ("dt dd", ["dl"]), "tr": ("tr td th", ["table"]), "td": ("td th", ["tr", "table"]),
    "th": ("td th", ["tr", "table"]), "option": ("option", ["select"]),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    __slots__ = ("children", "drop", "paragraph", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False):
        self.tag, self.parent, self.drop = tag, parent, drop
        #: the open p that a block element in here closes
        self.paragraph: Node | None = self if tag == "p" else None if parent is None or tag in _HOLDS_P else parent.paragraph
        self.children: list[Node | str] = []


def _is_dropped(tag: str, attributes: str) -> bool:
    if tag in _DROPPED:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return True
        if name in ("class", "id") and value.strip() in _CLASSES:
            return True
    return False


def parse(html: str) -> Node:
    """A tree of elements; end tags that are left out are supplied, stray ones ignored.  Each element is closed once, and
    none is looked for that isn't open, so deep trees take no longer than wide ones."""
    root = at = Node("", None)
    end, lower, first = 0, None, True
    position = 0
    n_open: Counter[str] = Counter()

    def closed(upto: Node) -> Node:
        """Closes the elements from ``at`` to ``upto``, and returns what is open then."""
        node = at
        while True:
            n_open[node.tag] -= 1
            if node is upto:
                return node.parent
            node = node.parent

    while m := _TOKEN.search(html, position):
        if m.start() > end:
            at.children.append(html[end : m.start()])
        end = position = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                at.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:
            up = at if n_open[tag] > 0 else root
            while up is not root and up.tag != tag:
                if tag in ("p", "b", "i", "a", "span", "em", "strong") and up.tag in ("article", "main", "section", "td", "body"):
                    up = root  # a stray inline end tag closes nothing around it
                    break
                up = up.parent
            if up is not root:
                at = closed(up)
            continue
        if tag in _CLOSES_P and at.paragraph is not None:
            at = closed(at.paragraph)
        if tag in _SIBLINGS:
            closes, scope = _SIBLINGS[tag]
            closes, up, found = closes.split(), at, None
            left = sum(n_open[c] for c in closes)
            while left and up is not root and up.tag not in scope:
                if up.tag in closes:
                    found = up
                    left -= 1
                up = up.parent
            if found is not None:
                at = closed(found)
        node = Node(tag, at, _is_dropped(tag, m[3]))
        at.children.append(node)
        if first and tag in ("article", "main"):
            first = False
            up = at
            while up is not root:  # what stands around a page's first article isn't dropped
                up.drop = False
                up = up.parent
        if tag in _RAW:
            lower = lower or html.lower()
            stop = lower.find(f"</{tag}", end)
            if stop < 0:
                end = position = len(html)
                break
            close = html.find(">", stop)
            if tag not in _DROPPED:
                node.children.append(html[end:stop])
            end = position = close + 1 if close >= 0 else len(html)
        elif tag not in _VOID and not m[3].rstrip().endswith("/") or tag in _BLOCK and tag not in _VOID:
            at = node
            n_open[tag] += 1
    if end < len(html):
        at.children.append(html[end:])
    return root


def _outermost(node: Node, tag: str, out: list[Node]) -> list[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.drop:
            continue
        if n.tag == tag:
            out.append(n)
        else:
            stack += [c for c in reversed(n.children) if not isinstance(c, str)]
    return out


def content(root: Node) -> list[Node]:
    """The outermost article elements, else main elements, else all."""
    for tag in ("article", "main"):
        if found := _outermost(root, tag, []):
            return found
    return [root]


def _walk(nodes: list[Node], templates: frozenset[int] | None, whole: bool = False) -> tuple[list[str], list[int]]:
    """The blocks' texts, and the hashes of block subtrees; with templates, subtrees whose hash is there are left out; the whole
    tree has dropped elements too, but for scripts and the like.

    A subtree's hash covers its tag, its own texts and its inner blocks' hashes, so the walk is linear; it is
    iterative, as pages may nest deeply.
    """
    texts: list[str] = []
    run: list[str] = []
    hashes: list[int] = []
    blocks: list[tuple[int, list[str]]] = [(0, [])]

    def flush() -> None:
        if run:
            if text := " ".join(unescape("".join(run)).split()):
                texts.append(text)
                blocks[-1][1].append(text)
            run.clear()

    for top in nodes:
        flush()
        stack = [(top, 0)]
        while stack:
            node, i = stack.pop()
            block = node.tag in _BLOCK
            if block and not i:
                flush()
                blocks.append((len(texts), []))
            if i < len(node.children):
                stack.append((node, i + 1))
                child = node.children[i]
                if isinstance(child, str):
                    run.append(child)
                elif child.tag == "br":
                    run.append(" ")
                elif not child.drop or whole and child.tag not in _UNSEEN:
                    stack.append((child, 0))
            elif block:
                flush()
                since, inside = blocks.pop()
                if inside:
                    seen = "\n".join([node.tag, *inside]).encode("utf-8", "surrogatepass")
                    h = int.from_bytes(blake2b(seen, digest_size=8).digest(), "little", signed=True)
                    hashes.append(h)
                    blocks[-1][1].append(f"\0{h}")
                    if templates and h in templates:
                        del texts[since:]
    flush()
    return texts, hashes


def extract(html: str | None, templates: frozenset[int] = frozenset()) -> str:
    """The main text of one page."""
    return "\n".join(_walk(content(parse(html)), templates)[0]) if html else ""


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            article, found = [], []
            for html in part.column("html").to_pylist():
                root = parse(html or "")
                article.append(hash(tuple(_walk(content(root), None)[1])))  # a tuple of integers: the same in every process
                found.append(sorted(set(_walk([root], None, whole=True)[1])))
            yield pa.RecordBatch.from_pydict({"host": part.column("host"), "article": pa.array(article, pa.int64()), "subtrees": pa.array(found, pa.list_(pa.int64()))})


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            texts = [extract(h, frozenset(t or ())) for h, t in zip(part.column("html").to_pylist(), part.column("templates").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"page_id": part.column("page_id").cast(pa.int64()), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}
            )


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, templates): the hashes of the subtrees that recur on each host."""
    seen = pages.select(host_of().alias("host"), "html").mapInArrow(_hashed, "host string, article long, subtrees array<long>")
    seen = written(seen, "subtrees")
    totals = seen.groupBy("host", "article").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("pages"))
    counts = seen.select("host", "article", F.explode("subtrees").alias("subtree")).distinct().groupBy("host", "subtree").agg(F.count("*").alias("on")).filter(F.col("on") >= least_pages)
    counts = join_small(counts, written(totals, "hosts"), "host", "inner").filter(F.col("on") >= least_share * F.col("pages"))
    return counts.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("templates"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    templates = written(site_templates(pages), "templates")
    rows = join_small(pages.select("page_id", "url", "html", host_of().alias("host")), templates, "host")
    return rows.select("page_id", "url", "html", "templates").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
