"""Main text of web pages; page furniture goes by site templates.

A task parses each page into a tree of elements. What the markup itself declares to be no article
(menus, footers, forms, scripts, adverts, reader comments, hidden parts) is left out. The text that
is left comes from the <article> elements, else from <main>, else from the whole body.

Site templates: every element's subtree is hashed (tags, classes, text). Spark counts per host on how
many different pages a hash occurs; subtrees that recur on many pages of their host are deleted.
Protected from that are elements around the article, and, within an <article> or <main>, its prose
(paragraphs, headings, quotes, list items, cells): a sentence that several articles of a site share
belongs to them, a box that they share doesn't. A page counts once however often it was fetched, so
copies of one page don't turn its own text into a template.
"""

from __future__ import annotations

import html as characters
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, left_join_by_key

#: A subtree is a template if it occurs on at least so many different pages of the host, however large that is.
LEAST_PAGES = 5

# --- fixed values: HTML's own element kinds, and words that sites use ---------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head script style noscript template nav footer aside form button select option input textarea iframe svg canvas "
    "menu dialog object embed video audio map title link meta xmp noembed noframes datalist".split()
)
CONTAINERS = frozenset("html body main article".split())
PROSE = frozenset(
    "p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption tr tbody thead tfoot table ol ul dl figure".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner sidebar "
    "sidenav menu nav navbar navigation navi topnav breadcrumb breadcrumbs header masthead footer cookie cookies "
    "cookiebar consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup "
    "login share sharing sharebar social related recommended recommendations comment comments commentlist discussion "
    "disqus respond reply replies widget widgets toolbar pagination pager skiplink search searchbox copyright".split()
)
#: Start tags that end an open element: tag -> (what they end, what they don't look beyond).
_BLOCKS = (
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul"
).split()
ENDS = {
    **{t: (frozenset(["p"]), frozenset("button td th caption table".split())) for t in _BLOCKS},
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][-\w:]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(page: str) -> Node:
    """The element tree of a page, open ends closed as browsers do for the common cases. Children are
    nodes and decoded strings."""
    root = Node("#page", {})
    stack, at = [root], 0
    open_ = Counter()  # open elements by tag: what isn't open needn't be looked for

    def close(i: int) -> None:
        open_.subtract(n.tag for n in stack[i:])
        del stack[i:]

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].children.append(characters.unescape(m[0]))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # the end of an inline element doesn't end blocks
            continue
        ends, beyond = ENDS.get(tag, (None, None))
        if ends and any(open_[t] for t in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in beyond:
                    break
        rest = m[3] or m[6] or ""
        attributes = {}
        if rest.strip(" /\n\t"):
            for a in _ATTRIBUTE.finditer(rest):
                attributes.setdefault(a[1].lower(), characters.unescape((a[2] or "").strip("\"'")))
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
        if tag in RAW or tag not in VOID:
            stack.append(node)
            open_[tag] += 1
    return root


def _furniture(node: Node, in_article: bool, holders: set[int]) -> bool:
    """Whether markup declares the element to be no part of an article."""
    tag, a = node.tag, node.attributes
    if tag in NEVER or tag == "header" and not in_article:
        return True
    if not a or tag in ("html", "body", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    return any(x.lower() in NAMES for x in _NAME.findall(a.get("class", "") + " " + a.get("id", ""))) and id(node) not in holders


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]


def _holders(root: Node) -> set[int]:
    """Elements with an article or main element inside, by identity."""
    found: set[int] = set()
    for n in reversed(list(_walk(root))):  # children before parents
        if any(isinstance(c, Node) and (c.tag in ("article", "main") or id(c) in found) for c in n.children):
            found.add(id(n))
    return found


def _hashes(root: Node) -> dict[int, int]:
    """A hash of each element's whole subtree, by identity of the node."""
    found: dict[int, int] = {}
    for node in reversed(list(_walk(root))):  # children before parents
        h = xxhash.xxh64(node.tag)
        h.update("|" + node.attributes.get("class", "") + "|" + node.attributes.get("id", ""))
        for c in node.children:
            if isinstance(c, Node):
                h.update(found[id(c)].to_bytes(8, "little", signed=True))
            elif c.strip():
                h.update("\x00" + " ".join(c.split()))
        found[id(node)] = h.intdigest() - (1 << 63)
    return found


def analyse(page: str) -> tuple[int, list[int], list[tuple[str, list[int]]]]:
    """(hash of the page, hashes of its subtrees that a template may delete, blocks); a block is its text
    and the hashes of such subtrees around it."""
    root = parse(page)
    hashes = _hashes(root)
    around = {id(root)}
    for n in _walk(root):
        if n.tag in CONTAINERS:
            around.add(id(n))
    for n in reversed(list(_walk(root))):
        if any(isinstance(c, Node) and id(c) in around for c in n.children):
            around.add(id(n))
    seen = sorted({hashes[id(n)] for n in _walk(root) if id(n) not in around and n.tag not in RAW and n.tag not in VOID})

    holders = _holders(root)
    for wanted in ("article", "main", None):
        blocks = _blocks(root, wanted, hashes, around, holders)
        if blocks:
            break
    return hashes[id(root)], seen, blocks


def _blocks(
    root: Node, wanted: str | None, hashes: dict[int, int], around: set[int], holders: set[int]
) -> list[tuple[str, list[int]]]:
    """Text blocks in page order, from within ``wanted`` elements (None: from anywhere)."""
    blocks: list[tuple[str, list[int]]] = []
    text: list[str] = []

    def flush(chain):
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            hold = []
            while chain:  # (hash, chain around it)
                hold.append(chain[0])
                chain = chain[1]
            blocks.append((line, hold[::-1]))

    # (node, within wanted, only headings, chain) to enter; (None, ...) ends a block element
    stack = [(root, wanted is None, False, ())]
    while stack:
        node, inside, headings, chain = stack.pop()
        if isinstance(node, str):
            if inside and not headings:
                text.append(node)
            continue
        if node is None:
            flush(chain)
            continue
        if _furniture(node, inside and wanted is not None, holders):
            if node.tag not in INLINE:
                text.append(" ")
            continue
        mine = inside or node.tag == wanted or wanted == "main" and node.attributes.get("role", "").lower() == "main"
        if node.tag == "header":
            headings = True
        elif node.tag in HEADINGS:
            headings = False
        if node.tag == "br":
            text.append(" ")
        block = node.tag not in INLINE
        if block:
            flush(chain)
        prose = wanted is not None and (node.tag in PROSE or not block)
        down = chain if id(node) in around or prose else (hashes[id(node)], chain)
        if block:
            stack.append((None, mine, headings, down))
        stack += [(c, mine, headings, down) for c in reversed(node.children)]
    return blocks


# --- the operator -------------------------------------------------------------------

_ANALYSED = pa.schema(
    [
        ("row", pa.int64()),
        ("host", pa.string()),
        ("page", pa.int64()),
        ("seen", pa.list_(pa.int64())),
        ("texts", pa.list_(pa.string())),
        ("chains", pa.list_(pa.list_(pa.int64()))),
    ]
)


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def _analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            out = []
            for value, url in zip(part.column("html"), part.column("url")):
                page, seen, blocks = analyse(value.as_py() or "")
                out.append((row, host_of(url.as_py()), page, seen, [b[0] for b in blocks], [b[1] for b in blocks]))
                row += 1
            columns = [pa.array(list(x), f.type) for x, f in zip(zip(*out), _ANALYSED)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("url"), *columns], names=["id", "url", *_ANALYSED.names]
            )


def templates(analysed: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(at: host and hash, pages) of subtrees on many different pages of their host. Counting is combined in the
    map tasks; what a third of all pages share is one row a task."""
    pages = analysed.groupBy("host", "page").agg(F.first("seen").alias("seen"))
    return (
        pages.select("host", F.explode("seen").alias("hash"))
        .groupBy(F.struct("host", "hash").alias("at"))
        .agg(F.count(F.lit(1)).alias("pages"))
        .filter(F.col("pages") >= least_pages)
    )


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Null and empty html give an empty text. Pages without a usable url share the host "". Rows that repeat
    an id, or have none, get a row each. An empty table gives an empty result. Other columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, url string, row bigint, host string, page bigint, seen array<bigint>, "
        "texts array<string>, chains array<array<bigint>>"
    )
    analysed = keep(rows.mapInArrow(_analysed, schema), "html-analysed")
    common = keep(templates(analysed, least_pages), "html-templates")
    inside = F.array_distinct(F.flatten("chains"))
    at_risk = analysed.filter(F.size(inside) > 0)
    held = keep(at_risk.select("row", "host", F.explode(inside).alias("hash")).select("row", F.struct("host", "hash").alias("at")), "html-inside")
    found = left_join_by_key(held, common, "at", "pages").filter("pages IS NOT NULL")  # a template of a hot host is hot
    hits = found.groupBy("row").agg(F.collect_list("at.hash").alias("gone"))  # no more than the page's own elements
    safe = analysed.filter(F.size(inside) == 0).select("id", "url", _joined(F.col("texts")).alias("text"))
    left = F.transform(
        F.filter(F.arrays_zip("texts", "chains"), lambda b: ~F.arrays_overlap(b["chains"], F.col("gone"))),
        lambda b: b["texts"],
    )
    no_hit = F.expr("CAST(array() AS array<bigint>)")
    cleaned = (
        at_risk.join(hits, "row", "left")
        .withColumn("gone", F.coalesce("gone", no_hit))
        .select("id", "url", _joined(left).alias("text"))
    )
    out = safe.unionByName(cleaned)
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars")
    )


def _joined(texts: Column) -> Column:
    return F.array_join(texts, "\n")
