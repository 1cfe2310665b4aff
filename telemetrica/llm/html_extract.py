"""Main-text extraction with a site style tree.

The pages of a host are merged by element path. For each path the host's pages give the entropy of its
presentation (the sequence of its children) and of its content (its own text), both relative to the
number of pages that have it; a path's importance blends its presentation with that of what stands
below it, down to the content of leaves. Few pages prove little, so ``DOUBT`` pages that all differ are
added to each path's own. Branches that look and read alike on all pages have a low importance, together
with all that stands below them, and are left out, as are elements whose tag, role or class says menu,
header, footer, sidebar, notice, advert, form or comments. Where a page has an article or main element,
its text is what stands inside, without the branches that the tree rates low, and what stands elsewhere
in paths that it rates high. Ratings are of paths, not of passages: one that many articles of a host share
is kept where the path reads differently on other pages. If the tree would leave nothing of the article,
or of a page without one, only the other rule holds.

Paths are chained 64-bit hashes, so nesting of any depth costs the same. Statistics are counts per host,
path and variant, summed before and after the shuffle; a host's pages are never gathered. A host's tree is:
paths on less than one in ``SUPPORT`` of its pages enter it as a weight of their parent only, so it has at
most ``SUPPORT`` times as many paths as a page, however many pages there are.

Defined results: a null html is empty and gives an empty text; pages without url share one host;
repeated pages are extracted one by one; unclosed and stray tags are tolerated; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Set
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetrica.llm.common import cut, map_batches, table

TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)", re.S)
LOOSE = re.compile(r"<(?:!--(?:.*?--!?>|.*)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table"
    " tbody td tfoot th thead title tr ul caption".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
LIMITS = frozenset("ul ol menu dl table article main section div nav aside form body select".split())
NOISE_TAGS = frozenset("nav aside form button select menu dialog head datalist fieldset".split())
NOISE_OUTSIDE = frozenset("header footer".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices gdpr sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs footer masthead comment comments disqus reply replies newsletter subscribe popup modal social share related"
    " contentinfo complementary search toolbar pagination pager alert".split()
)
CONTENT = frozenset(("article", "main"))
#: Branches of a smaller importance are left out; paths of the other one are kept beside an article.
LEAST_IMPORTANCE, HIGH_IMPORTANCE = 0.1, 0.5
#: Pages that are added to those of a path as if all differed.
DOUBT = 0.5
#: Weight of what stands below against a path's own presentation.
BELOW = 0.9
#: Paths on less than one in so many pages of a host aren't rated; less than this share of pages below a path says nothing of it.
SUPPORT, HEARD = 1000, 0.05
#: Rated paths that are sent to every task at most; beyond, pages and ratings are joined by host.
BROADCAST_PATHS = 2_000_000


class Node:
    __slots__ = ("tag", "path", "above", "within", "noise", "content", "children")

    def __init__(self, tag: str, path: int, above: int, within: bool, noise: bool, content: bool):
        self.tag, self.path, self.above, self.within, self.noise, self.content = tag, path, above, within, noise, content
        self.children: list[str] = []


def signals(attributes: str) -> tuple[str, bool]:
    """The key that class and id give an element, and whether they name noise."""
    found = ATTRIBUTE.findall(attributes)
    if not found:
        return "", False
    names = [n.strip("\"'") for _, n in found]
    noise = any(w.lower() in NOISE_NAMES for n in names for w in NAME.findall(n))
    return "." + ".".join(re.sub(r"\d+", "0", n) for n in names), noise


def walk(html: str):
    """Events of a page: ("open", node), ("text", node, text), ("break", node) and ("close", node)."""
    root = Node("", 0, 0, False, False, False)
    stack = [root]
    pattern, at, end = TAG, 0, len(html)

    def pop():
        return ("close", stack.pop())

    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            begin = end
        if begin > at:
            yield ("text", stack[-1], html[at:begin])
        if begin == end:
            break
        m = pattern.match(html, begin)
        if m is None and pattern is TAG and html[begin + 1 : begin + 2].isalpha() and (m := LOOSE.match(html, begin)):
            pattern = LOOSE  # a quote is not closed: attributes end at the next >
        if m is None:
            yield ("text", stack[-1], "<")
            at = begin + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                yield ("break", stack[-1])
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        yield pop()
                    break
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = closing.end() if closing else end
            continue
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    while len(stack) > k:
                        yield pop()
                    break
                if stack[k].tag in LIMITS and not (tag in ("tr", "td", "th") and stack[k].tag != "table"):
                    break
        elif tag in BLOCK and tag != "br":
            # a block ends an open paragraph and the inline elements left open in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    while len(stack) > k:
                        yield pop()
                    break
                if stack[k].tag in BLOCK:
                    break
        key, noise = signals(m[3])
        parent = stack[-1]
        content = parent.content or (tag in CONTENT and not noise)
        noise = parent.noise or noise or tag in NOISE_TAGS or (tag in NOISE_OUTSIDE and not parent.content) or (tag == "footer")
        path = xxhash.xxh64_intdigest(tag + key, parent.path) >> 1
        node = Node(tag, path, parent.path, parent.within or tag in CONTENT, noise, content and not noise)
        if tag in BLOCK:
            yield ("break", parent)
        parent.children.append(tag + key)
        yield ("open", node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            yield ("close", node)
        else:
            stack.append(node)
    while len(stack) > 1:
        yield pop()


def variants(html: str) -> list[tuple[int, int, bool, int, int]]:
    """Per element path of a page: the path above, whether it is within an article, and hashes of its presentation and content."""
    shown: dict[int, int] = {}
    said: dict[int, int] = {}
    place: dict[int, tuple[int, bool]] = {}
    for event in walk(html):
        node = event[1]
        if event[0] == "open":
            said.setdefault(node.path, 0)
            place[node.path] = node.above, node.within
        elif event[0] == "text":
            text = " ".join(event[2].split())
            if text:
                said[node.path] = zlib.crc32(text.encode("utf-8", "replace"), said.get(node.path, 0) + 1)
        elif event[0] == "close":
            kinds = [c for k, c in enumerate(node.children) if not k or c != node.children[k - 1]]
            shown[node.path] = zlib.crc32("\x00".join(kinds).encode("utf-8", "replace"), shown.get(node.path, 0) + 1)
    return [(p, *place[p], shown.get(p, 0), h) for p, h in said.items() if p]


def tidy(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split())


def extract(html: str, low: Set[int] = frozenset(), high: Set[int] = frozenset(), rules: bool = True) -> str:
    """The main text of a page whose host's tree rates the paths in ``low`` as unimportant and those in ``high`` as important.

    Without ``rules`` tags and classes name neither noise nor articles: only the tree decides.
    """
    inside: list[str] = []  # blocks of article and main
    main: list[str] = []  # those the tree keeps, and blocks elsewhere that it rates high
    plain: list[str] = []  # blocks elsewhere
    rated: list[str] = []  # blocks elsewhere that the tree keeps
    held: dict[str, list[str]] = {"inside": [], "main": [], "plain": [], "rated": []}
    kept = False  # whether the tree keeps any of article and main

    def flush() -> None:
        for name, blocks in (("inside", inside), ("main", main), ("plain", plain), ("rated", rated)):
            if held[name]:
                if block := tidy(held[name]):
                    blocks.append(block)
                held[name] = []

    chain: list[bool] = [False]
    for event in walk(html):
        kind, node = event[0], event[1]
        if kind == "break":
            flush()
        elif kind == "open":
            chain.append(chain[-1] or node.path in low)
        elif kind == "close":
            chain.pop()
        elif not (node.noise and rules):
            content = node.content and rules
            held["inside" if content else "plain"].append(event[2])
            if chain[-1]:
                continue
            if content:
                held["main"].append(event[2])
                kept = kept or not event[2].isspace()
            else:
                held["rated"].append(event[2])
                if node.path in high:
                    held["main"].append(event[2])
    flush()
    return "\n".join((main if kept else inside) if inside else rated or plain)


HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", re.I)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def tree(pages: DataFrame) -> DataFrame:
    """Per host: low, the uppermost element paths of unimportant branches, and high, important paths outside of articles. pages: (url, html)."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = host_of(url)
            found.update((host, *v) for v in variants(html or ""))
        columns = list(zip(*found, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        names = ["host", "path", "above", "within", "shown", "said", "n"]
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], pa.array(found.values(), pa.int64())], names)

    counts = map_batches(pages.select("url", "html"), count, "host string, path long, above long, within boolean, shown long, said long, n long")
    node = ("host", "path", "above", "within")
    counts = cut(counts.groupBy(*node, "shown", "said").agg(F.sum("n").alias("n")))

    def entropy(kind: str) -> DataFrame:
        by = counts.groupBy(*node, kind).agg(F.sum("n").alias("n"))
        by = by.groupBy(*node).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
        return by.select(*node, "m", F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0).alias(kind))

    both = cut(entropy("shown").join(entropy("said").drop("m"), [*node]))
    most = both.groupBy("host").agg(F.max("m").alias("pages"))
    marked = both.join(most, "host").withColumn("rated", F.col("m") * SUPPORT >= F.col("pages"))
    rare = marked.where("not rated").groupBy("host", F.col("above").alias("path")).agg(F.sum("m").alias("rare"))
    rated = marked.where("rated").join(rare, ["host", "path"], "left")

    def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [ratings([(x["path"], x["above"], x["within"], x["m"], x["shown"], x["said"], x["rare"] or 0) for x in paths]) for paths in batch.column("paths").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("host"), *[pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)]], ["host", "low", "high"])

    # at most SUPPORT times the paths of a page each
    gathered = rated.groupBy("host").agg(F.collect_list(F.struct("path", "above", "within", "m", "shown", "said", "rare")).alias("paths"))
    return map_batches(gathered, rate, "host string, low array<long>, high array<long>")


def ratings(paths: list[tuple[int, int, bool, int, float, float, int]]) -> tuple[list[int], list[int]]:
    """Of a host's tree, each path with (path, above, within an article, pages, presentation, content, pages of rare paths below):
    the uppermost paths that are low with all below them, and the high ones outside of articles.
    """
    of = {x[0]: x for x in paths}
    below: dict[int, list[int]] = {}
    for p, x in of.items():
        below.setdefault(x[1], []).append(p)
    order = [p for p, x in of.items() if x[1] not in of]
    for p in order:
        order += below.get(p, ())
    importance: dict[int, float] = {}
    most: dict[int, float] = {}  # of a path and what stands below it on enough of its pages
    for p in reversed(order):
        _, _, _, m, shown, content, rare = of[p]
        inner = [(importance[c], of[c][3]) for c in below.get(p, ())] + ([(1.0, rare)] if rare else [])
        if inner:
            content = max(content, sum(i * w for i, w in inner) / sum(w for _, w in inner))
        importance[p] = (m * ((1 - BELOW) * shown + BELOW * content) + DOUBT) / (m + DOUBT)
        most[p] = max([importance[p], *[most[c] for c in below.get(p, ()) if of[c][3] >= HEARD * m], float(rare >= HEARD * m and rare > 0)])
    low = {p for p in order if most[p] < LEAST_IMPORTANCE}
    sure = {p for p in order if importance[p] - DOUBT / (of[p][3] + DOUBT) >= HIGH_IMPORTANCE}
    return sorted(p for p in low if of[p][1] not in low), sorted(p for p in sure if not of[p][2])


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    kind = pages.schema["page_id"].dataType.simpleString()
    low = cut(tree(pages).where((F.size("low") > 0) | (F.size("high") > 0)))
    few = (low.agg(F.sum(F.size("low") + F.size("high"))).first()[0] or 0) <= BROADCAST_PATHS
    named = pages.select("page_id", "url", "html").withColumn("host", host_column())

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets: dict[tuple, frozenset] = {}
        texts = []
        for html, *paths in zip(*[batch.column(c).to_pylist() for c in ("html", "low", "high")], strict=True):
            keys = [tuple(p or ()) for p in paths]
            texts.append(extract(html or "", *[sets.setdefault(k, frozenset(k)) for k in keys]))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    joined = named.join(F.broadcast(low) if few else low, "host", "left")
    return map_batches(joined.select("page_id", "url", "html", "low", "high"), rows, f"page_id {kind}, url string, text string, n_chars long")


def host_column():
    """The host of ``url``, as ``host_of`` gives it."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op10_main_text": op10_main_text}
ORACLES: dict[str, str] = {}
