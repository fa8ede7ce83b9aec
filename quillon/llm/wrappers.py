"""Main text of pages by wrapper induction.

A page is parsed to a tree in which neighbouring siblings of the same kind (tag, class, role) are one node. Per host, the
most frequent tree is the reference; every other distinct tree is aligned with it by simple tree matching, so that
corresponding nodes share a name. Counting the texts of each name over all distinct pages of the host tells constant
nodes, the template, from varying slots. The content of a tree is its smallest subtree that holds at least SHARE of the
host's varying text outside links; extraction keeps the varying slots in there. Marks of menus, headers, footers, sidebars,
notices, adverts, forms and comments (tags, classes, roles) only leave out what lies inside the content and varies too.
Where a host has fewer than CONSTANT_PAGES pages nothing can be induced: there the content is the largest article or main
element, else the body.

Pages of a host never meet in one task: trees and texts are counted, and only distinct trees are aligned, each with its
reference alone. What is induced goes to a page by the hash of the page, not by its host.

Nulls and ties: a null or empty html gives an empty text; a null url or one without a host belongs to the host "";
equal pages count once for the template and are each extracted; equally frequent trees are ordered by their form. Rows
that share a page_id stay rows of their own. An empty table gives no rows. Other columns are ignored. Broken, cut and
deeply nested markup is read as far as it goes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|type)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: Fixed values of HTML: elements without content, with raw text, that begin a new line, and what ends an open element.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = set("article aside body blockquote div section td th li table form main nav header footer button".split())
#: Fixed values of HTML: elements that hold blocks of text.
CONTAINERS = set("article blockquote body center details div form html main section td".split()) | {""}
#: Elements and words of class or id that mark what is not the article.
ASIDE_TAGS = set("head nav footer aside form script style noscript template iframe button select textarea dialog menu object svg canvas audio video".split())
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list cookie cookies consent disqus "
    "footer header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted "
    "promotion related reply replies search share sharing sidebar signup site-footer site-header skip social sponsor sponsored subscribe toolbar "
    "widget cookie-banner cookie-notice page-header page-footer reader-comments".split()
)
SPACE = re.compile(r"\s+")
CONSTANT_PAGES, CONSTANT_SHARE, SHARE, BROADCAST_NODES = 4, 0.8, 0.6, 1_000_000


class Node:
    __slots__ = ("label", "tag", "aside", "link", "article", "children", "at")

    def __init__(self, label: str, tag: str, aside: bool, link: bool, article: int, at: int):
        self.label, self.tag, self.aside, self.link, self.article, self.children, self.at = label, tag, aside, link, article, [], at


def parse(text: str) -> tuple[list[Node], list[tuple[Node | None, int, str]]]:
    """The nodes in order of appearance, and the text segments: node, article that it is in (0: none), text; breaks
    between blocks are segments of no node."""
    root = Node("", "", False, False, 0, 0)
    nodes, segments, stack, at, articles = [root], [], [(root, 0)], 0, 0
    size, lower = len(text), None
    for m in iter(lambda: MARKUP.search(text, at), None):
        if m.start() > at:
            segments.append((stack[-1][0], stack[-1][1], text[at : m.start()]))
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            segments.append((None, 0, ""))
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        closing, stop = ENDS.get(tag, (None, None))
        if closing is None and tag in BLOCK:
            closing, stop = {"p"}, SCOPE
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0].tag in closing:
                    del stack[i:]
                    break
                if stack[i][0].tag in stop:
                    break
        parent, article = stack[-1]
        words, kind = "", ""
        if m[3].strip():
            given = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(m[3])}
            words = " ".join(sorted({w for k in ("class", "id") for w in given.get(k, "").split()}))
            kind = " ".join(given.get("role", "").split()) or ("hidden" if "hidden" in given else "")
        label = f"{tag}|{words}|{kind}"
        if tag == "article" or tag == "main" or kind in ("main", "article"):
            if not article:
                articles += 1
                article = articles
        node = parent.children[-1] if parent.children and parent.children[-1].label == label else None
        if node is None:
            marked = tag in ASIDE_TAGS or kind in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "hidden") or any(w in ASIDE_WORDS or any(p in ASIDE_WORDS for p in re.split(r"[-_]+", w)) for w in words.split())
            node = Node(label, tag, parent.aside or marked or (tag == "header" and not article), parent.link or tag == "a", article, len(nodes))
            nodes.append(node)
            parent.children.append(node)
        if tag in RAW:
            lower = lower or text.lower()
            end = lower.find("</" + tag, at)
            at = size if end < 0 else end
        stack.append((node, article))
    if at < size and text[at] != "<":
        segments.append((stack[-1][0], stack[-1][1], text[at:]))
    elif at < size:
        cut = text.find(">", at)
        if cut < 0 and not re.match(r"</?[a-zA-Z!]", text[at:]):
            segments.append((stack[-1][0], stack[-1][1], text[at:]))
    return nodes, segments


def shape(nodes: list[Node]) -> str:
    """The tree as text: the depth and label of each node, in order."""
    out, stack = [], [(nodes[0], 0)]
    while stack:
        node, depth = stack.pop()
        out.append(f"{depth} {node.label}")
        stack.extend((c, depth + 1) for c in reversed(node.children))
    return "\n".join(out)


def labels_of(tree: str) -> tuple[list[str], list[list[int]]]:
    """Labels and children of a shape's nodes, in the order of its text."""
    labels, children, path = [], [], []
    for at, row in enumerate(tree.split("\n")):
        depth, _, label = row.partition(" ")
        labels.append(label)
        children.append([])
        del path[int(depth) :]
        if path:
            children[path[-1]].append(at)
        path.append(at)
    return labels, children


def ends_of(children: list[list[int]]) -> list[int]:
    """For each node the place after its subtree."""
    ends = [0] * len(children)
    for i in range(len(children) - 1, -1, -1):
        ends[i] = ends[children[i][-1]] if children[i] else i + 1
    return ends


def in_order(nodes: list[Node]) -> list[int]:
    """For each node, its place in the order of labels_of()."""
    out, stack, n = [0] * len(nodes), [nodes[0]], 0
    while stack:
        node = stack.pop()
        out[node.at] = n
        n += 1
        stack.extend(reversed(node.children))
    return out


def matched(a: str, b: str) -> dict[int, int]:
    """Simple tree matching: for nodes of b the nodes of a in the largest top-down, order-keeping match of equal labels."""
    (la, ca), (lb, cb) = labels_of(a), labels_of(b)
    todo = [(0, 0)] if la[0] == lb[0] else []
    for i, j in todo:  # pairs of equal labels with matching parents, parents first
        todo.extend((x, y) for x in ca[i] for y in cb[j] if la[x] == lb[y])
    weight: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], list[list[int]]] = {}
    for i, j in reversed(todo):
        x, y = ca[i], cb[j]
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(len(x)):
            for q in range(len(y)):
                t[p + 1][q + 1] = max(t[p][q + 1], t[p + 1][q], t[p][q] + weight.get((x[p], y[q]), 0))
        weight[i, j], tables[i, j] = 1 + t[-1][-1], t
    out, todo = {}, todo[:1]
    while todo:
        i, j = todo.pop()
        out[j] = i
        t, x, y = tables[i, j], ca[i], cb[j]
        p, q = len(x), len(y)
        while p and q:
            w = weight.get((x[p - 1], y[q - 1]), 0)
            if w and t[p][q] == t[p - 1][q - 1] + w:
                todo.append((x[p - 1], y[q - 1]))
                p, q = p - 1, q - 1
            elif t[p][q] == t[p - 1][q]:
                p -= 1
            else:
                q -= 1
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def node_texts(nodes: list[Node], segments: list) -> dict[int, str]:
    """The text of each node that has some, by its place in the shape."""
    order, held = in_order(nodes), {}
    for node, _, text in segments:
        if node is not None and not text.isspace():
            held.setdefault(order[node.at], []).append(text)
    return {k: SPACE.sub(" ", " ".join(v)).strip() for k, v in held.items()}


def content(ends: list[int], mass: list[float], tags: list[str], share: float = SHARE) -> int:
    """The deepest node on the way down whose subtree holds at least `share` of all mass, or what a mere paragraph of that
    kind stands in, so that its headings belong to it; -1 without any mass."""
    upto = [0.0]
    for m in mass:
        upto.append(upto[-1] + m)
    if upto[-1] <= 0:
        return -1
    best = 0
    for i, end in enumerate(ends):  # in order, so a deeper one comes later; two with so much mass lie in each other
        if upto[end] - upto[i] >= share * upto[-1]:
            best = i
    while best and tags[best] not in CONTAINERS:
        best = max(i for i in range(best) if ends[i] >= ends[best])
    return best


Wrapper = tuple[int, int, frozenset[int]]  #: the content's first node, the one after it, and the constant nodes


def main_text(page: str, wrapper: Wrapper | None = None) -> str:
    """The article's text; without a wrapper, that of the largest article or main element, else of the body."""
    return text_of(*parse(page), wrapper)


def text_of(nodes: list[Node], segments: list[tuple[Node | None, int, str]], wrapper: Wrapper | None) -> str:
    """main_text() of a parsed page."""
    keep = [not n.aside for n in nodes]
    if wrapper is not None:
        first, after, gone = wrapper
        for n, at in zip(nodes, in_order(nodes), strict=True):
            keep[n.at] = keep[n.at] and first <= at < after and at not in gone
    else:
        lengths: dict[int, int] = {}
        for node, article, text in segments:
            if node is not None and article and keep[node.at]:
                lengths[article] = lengths.get(article, 0) + len(text)
        best = max(lengths, key=lambda a: (lengths[a], -a), default=0)
        if best:
            for n in nodes:
                keep[n.at] = keep[n.at] and n.article == best
    out = [" " if node is None else text for node, _, text in segments if node is None or keep[node.at]]
    return SPACE.sub(" ", html.unescape("".join(out))).strip()


def shape_key(host: str, tree: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\n{tree}".encode("utf-8", "surrogatepass")) - (1 << 63)


def keyed(pages: DataFrame) -> DataFrame:
    """pages with host and _page, the hash of host and html."""
    host = host_of(F.col("url"))
    return pages.withColumn("_host", host).withColumn("_page", F.xxhash64(host, F.coalesce("html", F.lit(""))))


def seen(pages: DataFrame) -> DataFrame:
    """For each keyed page: host, page, key, tree, and of its nodes with text the hash of the text and its length outside links."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, name, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes, segments = parse(page or "")
                tree, texts, order = shape(nodes), node_texts(nodes, segments), in_order(nodes)
                link = {order[n.at] for n in nodes if n.link}
                out.append((host, name, shape_key(host, tree), tree, list(texts), [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts.values()], [0 if k in link else len(t) for k, t in texts.items()]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["host", "page", "key", "tree", "nodes", "texts", "mass"])

    return pages.select("_host", "_page", "html").mapInArrow(scan, "host string, page long, key long, tree string, nodes array<int>, texts array<long>, mass array<int>")


def induced(s: DataFrame, least: int = CONSTANT_PAGES, share: float = CONSTANT_SHARE) -> DataFrame:
    """key, first, after and gone of every shape of every host with enough pages: the content's subtree and its constant
    nodes; s is a table of seen() with each page once."""
    shapes = written(s.groupBy("host", "key", "tree").agg(F.count("*").alias("n")), "shapes")
    first = shapes.groupBy("host").agg(F.max(F.struct("n", "tree")).alias("most"), F.sum("n").alias("pages"))
    first = first.select(F.col("host").alias("_host"), F.col("most.tree").alias("reference"), "pages").where(F.col("pages") >= least)
    pairs = shapes.join(first, F.col("host") == F.col("_host")).select("host", "key", "tree", "reference", "pages")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = matched(r["reference"], r["tree"])
                labels, children = labels_of(r["tree"])
                for j, end in enumerate(ends_of(children)):
                    name = f"r{found[j]}" if j in found else f"{r['key']}:{j}"
                    out.append((r["host"], r["key"], j, end, labels[j].partition("|")[0], name, r["pages"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "key", "node", "end", "tag", "name", "pages"])

    names = written(pairs.mapInArrow(align, "host string, key long, node int, end int, tag string, name string, pages long"), "names")
    texts = s.select("key", F.explode(F.arrays_zip("nodes", "texts", "mass")).alias("x")).groupBy("key", F.col("x.nodes").alias("node"), F.col("x.texts").alias("text")).agg(F.count("*").alias("n"), F.sum("x.mass").alias("mass"))
    texts = texts.withColumnRenamed("key", "_key").withColumnRenamed("node", "_node")
    named = names.join(texts, (F.col("key") == F.col("_key")) & (F.col("node") == F.col("_node")))
    counts = named.groupBy("host", "name", "text").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.first("pages").alias("pages"))
    slots = counts.groupBy("host", "name").agg(F.max("n").alias("most"), F.sum("mass").alias("mass"), F.first("pages").alias("pages"))
    constant = (F.col("most") >= least) & (F.col("most") >= share * F.col("pages"))
    slots = slots.select(F.col("host").alias("_host"), F.col("name").alias("_name"), constant.alias("gone"), F.when(constant, 0.0).otherwise(F.col("mass") / F.col("pages")).alias("mass"))
    every = names.join(slots, (F.col("host") == F.col("_host")) & (F.col("name") == F.col("_name")), "left")
    trees = every.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "end", F.coalesce("gone", F.lit(False)).alias("gone"), F.coalesce("mass", F.lit(0.0)).alias("mass"), "tag"))).alias("nodes"))  # bounded by the tree

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best = content([n["end"] for n in nodes], [n["mass"] for n in nodes], [n["tag"] for n in nodes])
                if best >= 0:
                    after = nodes[best]["end"]
                    out.append((key, best, after, [n["node"] for n in nodes[best:after] if n["gone"]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())), strict=True)], ["key", "first", "after", "gone"])

    return trees.mapInArrow(choose, "key long, first int, after int, gone array<int>")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    rows = keyed(pages.select("page_id", "url", "html"))
    s = written(seen(rows), "shapes").dropDuplicates(["page"])
    template = written(induced(s), "template")
    size = template.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("m")).first()
    few = size.n + size.m <= BROADCAST_NODES
    if few:  # at most BROADCAST_NODES numbers
        shared = spark.sparkContext.broadcast({r.key: (r.first_, r.after, frozenset(r.gone)) for r in template.withColumnRenamed("first", "first_").collect()})
        rows = rows.withColumn("wrapper", F.lit(None).cast("struct<first:int,after:int,gone:array<int>>"))
    else:
        of = s.select(F.col("page").alias("_p"), "key").join(template, "key").select("_p", F.struct("first", "after", "gone").alias("wrapper"))
        rows = rows.join(of, F.col("_page") == F.col("_p"), "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, page, wrapper in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                nodes, segments = parse(page or "")
                if few:
                    known = shared.value.get(shape_key(host, shape(nodes))) if shared.value else None
                else:
                    known = wrapper and (wrapper["first"], wrapper["after"], frozenset(wrapper["gone"]))
                texts.append(text_of(nodes, segments, known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)
    return rows.select("page_id", "url", "_host", "html", "wrapper").mapInArrow(extract, f"page_id {kind['page_id']}, url string, text string, n_chars long")
