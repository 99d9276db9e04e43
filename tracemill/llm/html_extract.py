"""Main text of web pages by wrapper induction over the pages of a host.

Marks first: a piece of text (a run between two block boundaries) is a candidate unless it lies in a region that is marked
as something else (navigation, advert, form, comments ...), and where a page marks its article, inside that article.

Then every page of a host votes on its candidates, each by its place (tags and names from the root to the element that
holds it) and its text.  A text that nearly all pages with that place have there is template, whichever pages they are, so
layouts of a host and blocks that some pages lack are judged on the pages that have them, and siblings one by one.  Pages
with the same candidates are copies and vote once.  Only fingerprints are shuffled, so a host may hold any share of the pages.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import query, read, write_stage
from tracemill.session import small

#: A text is template when at least this share of the distinct pages that have its place have it there, two at least.
CONSTANT = 0.9
#: Texts on fewer distinct pages than this may also be shared by near copies: they go only if they are not most of a page.
LEAST_PAGES = 8

# HTML element names and the words that name regions.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select option datalist button object canvas audio video head".split())
REGIONS = frozenset("nav footer aside form menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner sidebar sidebars aside widget widgets menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments reply replies discussion disqus respond reactions copyright legal disclaimer pagination pager footer header toolbar skip".split()
)
CONTENT_NAMES = frozenset("article articlebody content post story entry main maintext text body".split())
CLOSED_BY = {
    "p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre section article aside nav header footer form hr main figure address fieldset details li".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "option": frozenset(["option"]),
}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[^a-z0-9]+")
#: Classes that speak of the layout around them, such as "has-sidebar".
LAYOUT = re.compile(r"(?:has|with|no|without|is|layout|page|col|two|three)[-_]")


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "children", "parent")

    def __init__(self, tag, parent=None, attributes=""):
        self.tag, self.parent, self.children = tag, parent, []
        self.names, self.role, self.hidden = frozenset(), "", False
        if attributes.strip(" /"):
            got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            words = " ".join(got.get(k, "") for k in ("class", "id", "itemprop"))
            words = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", words).lower()
            self.names = frozenset(n for w in words.split() if not LAYOUT.match(w) for n in SPLIT.split(w) if n)
            self.role = got.get("role", "").lower()
            self.hidden = "hidden" in got or "display:none" in got.get("style", "").replace(" ", "").lower()


def parse(html: str) -> Node:
    """A forgiving tree: unknown end tags are passed over, open elements close with their parents."""
    root = Node("html")
    node, at, n = root, 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            node.children.append(html[at:])
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                if up.tag in ("td", "th", "table", "article", "main") and tag in INLINE:
                    up = root  # an inline end tag does not close a section
                    break
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in ("html", "body"):
            if node is root and tag == "body":
                node.children.append(child := Node(tag, node, m[3]))
                node = child
            continue
        if node.tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            node = node.parent
        up = node  # an open paragraph or item ends where the next begins, also below open inline elements
        while up.tag in INLINE and up.parent is not None:
            up = up.parent
        if tag in CLOSED_BY.get(up.tag, ()):
            node = up.parent
        child = Node(tag, node, m[3])
        node.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            node = child
    return root


def clean(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split())


def holds(node: Node, tags) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag in tags and x is not node:
            return True
        stack.extend(c for c in x.children if isinstance(c, Node))
    return False


def is_region(node: Node, inside: bool) -> bool:
    """A part of the page that is no article text.  ``inside``: within the article, where a header is its own."""
    if node.tag in SKIPPED or node.hidden:
        return True
    marked = node.tag in REGIONS or node.role in ROLES or bool(node.names & NAMES)
    if node.tag == "header" and not inside:
        marked = True
    if inside and node.names & NAMES <= {"header"} and node.tag not in REGIONS and node.role not in ROLES:
        marked = False
    if node.tag in ("html", "body"):
        return False
    return marked and not (not inside and holds(node, ("article", "main")))


def article_roots(root: Node) -> list[Node]:
    """The marked article parts, else the largest part named as content, else the whole page."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "named": []}

    stack: list = list(reversed(root.children))
    while stack:
        c = stack.pop()
        if not isinstance(c, Node) or c.tag in INLINE or is_region(c, False):
            continue
        if c.tag == "article":
            found["article"].append(c)
            continue
        if c.tag == "main" or c.role == "main":
            found["main"].append(c)
        elif c.names & CONTENT_NAMES and c.tag in ("div", "section", "td"):
            found["named"].append(c)
        stack.extend(reversed(c.children))

    size = {k: sum(len(t) for x in v for t in blocks(x, True)) for k, v in found.items() if k != "named"}
    if found["article"] and size["article"] * 2 >= size["main"]:
        return found["article"]
    if found["main"] and size["main"]:
        return found["main"][:1]
    if found["named"]:
        best = max(found["named"], key=lambda x: sum(map(len, blocks(x, True))))
        if any(blocks(best, True)):
            return [best]
    return [root]


def runs(node: Node, inside: bool) -> list[tuple[Node, str, bool]]:
    """Texts of the blocks below ``node`` in page order, without regions: element that holds it, text, nothing but links?"""
    out: list[tuple[Node, str, bool]] = []
    part: list[str] = []
    plain: list[str] = []
    stack: list = [(c, node, False, False) for c in reversed(node.children)]

    def flush(owner):
        if part:
            text = clean(part)
            if text:
                out.append((owner, text, not any(c.isalnum() for c in clean(plain))))
            part.clear(), plain.clear()

    while stack:
        x, owner, linked, closing = stack.pop()
        if closing:
            flush(x)
        elif isinstance(x, str):
            part.append(x)
            if not linked:
                plain.append(x)
        elif x.tag in ("br", "wbr"):
            part.append(" " if x.tag == "br" else "")
        elif is_region(x, inside):
            if x.tag not in INLINE and x.tag not in ("script", "style"):
                flush(owner)
        elif x.tag in INLINE:
            stack.extend((c, owner, linked or x.tag == "a", False) for c in reversed(x.children))
        else:
            flush(owner)
            stack.append((x, owner, linked, True))
            stack.extend((c, x, linked, False) for c in reversed(x.children))
    flush(node)
    return out


def blocks(node: Node, inside: bool) -> list[str]:
    return [text for _, text, _ in runs(node, inside)]


def candidates(root: Node) -> list[tuple[Node, str]]:
    """What the marks of the page alone leave: element and text."""
    roots = article_roots(root)
    inside = roots != [root]
    found = [r for x in roots for r in runs(x, inside)]
    if not inside and len(found) > 1:  # no marked article: blocks of links only go
        found = [r for r in found if not r[2]]
    return [(x, text) for x, text, _ in found]


def _print(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


class Places:
    """Fingerprints of the places of a page: tags and names (but numbers) from the root on."""

    def __init__(self):
        self.known: dict[int, int] = {}

    def of(self, node: Node) -> int:
        way = []
        while node is not None and id(node) not in self.known:
            way.append(node)
            node = node.parent
        at = self.known[id(node)] if node is not None else 0
        for x in reversed(way):
            label = " ".join([x.tag, *sorted(n for n in x.names if not n.isdigit())])
            at = self.known[id(x)] = _print(at.to_bytes(8, "little", signed=True) + label.encode())
        return at


def unit(place: int, text: str) -> int:
    return _print(place.to_bytes(8, "little", signed=True) + text.encode("utf-8", "surrogatepass"))


def votes(batches):
    """Per page: a row for each place that holds a candidate (``unit`` is the place) and for each text there, each once."""
    for batch in batches:
        hosts, columns = [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found, places = candidates(parse(html)), Places()
            voter = _print("\n".join(text for _, text in found).encode("utf-8", "surrogatepass"))
            rows = set()
            for x, text in found:
                place = places.of(x)
                rows |= {(place, place, voter), (place, unit(place, text), voter)}
            hosts.extend([host] * len(rows)), columns.extend(rows)
        place, units, voter = np.array(columns, np.int64).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in (place, units, voter))], ["host", "place", "unit", "voter"])


def main_text(html: str, sure: list[int] | None = None, likely: list[int] | None = None) -> str:
    """The candidates of a page without template: texts ``sure`` to be, and those ``likely`` unless most of the page would go."""
    found = candidates(parse(html))
    if sure or likely:
        places, sure, likely = Places(), set(sure or ()), set(likely or ())
        marks = [unit(places.of(x), text) for x, text in found]
        found = [(f, m) for f, m in zip(found, marks, strict=True) if m not in sure]
        held = sum(len(text) for (_, text), m in found if m in likely)
        copy = 2 * held > sum(len(text) for (_, text), _ in found)
        found = [f for f, m in found if copy or m not in likely]
    return "\n".join(text for _, text in found)


def extract(names: list[str]):
    def run(batches):
        for batch in batches:
            texts = [main_text(html or "", sure, likely) for html, sure, likely in zip(*(batch.column(c).to_pylist() for c in ("html", "sure", "likely")), strict=True)]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return run


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages`` (``page_id, url, html``).

    A null or empty page gives the empty text; pages without a url form one host; pages with the same candidates vote once and
    get one row each; on a host with one distinct page the marks of the page alone decide.  Other columns are not read.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html").withColumn("host", F.xxhash64(host))
    voted = rows.filter("html IS NOT NULL").select("host", "html").mapInArrow(votes, "host long, place long, unit long, voter long")
    counts = voted.distinct().groupBy("host", "place", "unit").agg(F.count("*").alias("n")).filter("n > 1")
    counts = write_stage(counts, "counts")  # what two distinct pages share
    having = counts.filter("unit = place").select("host", "place", F.col("n").alias("having"))
    constant = counts.filter("unit <> place").join(small(having), ["host", "place"]).filter(F.col("n") >= CONSTANT * F.col("having"))
    sure = F.col("n") >= LEAST_PAGES
    lists = [F.sort_array(F.collect_list(F.when(c, F.col("unit")))).alias(name) for c, name in ((sure, "sure"), (~sure, "likely"))]
    templates = write_stage(constant.groupBy("host").agg(*lists), "templates")
    joined = rows.join(small(templates), "host", "left")
    kinds = dict(rows.dtypes)
    return joined.mapInArrow(extract(["page_id", "url"]), f"page_id {kinds['page_id']}, url string, text string, n_chars long")


@query("op9_html_extract")
def op9(spark, sf_dir):
    return main_texts(read(spark, sf_dir, "pages"))
