"""The query surface: what an input string asks for, selectors, and pipes of operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_name, glob_to_like
from ..operators import graph

SELECTOR = re.compile(r"^(func|name|pkg|file|kind|path):(\S+)$")


def lane(text: str) -> str:
    """pipe, selector, reference (path:line), symbol, or prose, by the shape of the input."""
    text = text.strip()
    if re.search(r"\s\|\s", text):
        return "pipe"
    if text and all(SELECTOR.match(x) for x in text.split()):
        return "selector"
    if re.fullmatch(r"\S+\.\w+:\d+(?:-\d+)?", text):
        return "reference"
    if re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*(?:\(\))?", text):
        return "symbol"
    return "prose" if text else "empty"


#: Shapes of names in a question, and the patterns of intents in the order in which they are tried.
QUALIFIED = r"\(\*?[A-Z][A-Za-z0-9_]*\)\.[A-Za-z_][A-Za-z0-9_]*|\b[A-Z][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\b"
PASCAL = r"\b[A-Z][A-Za-z0-9_]{2,}\b"
CAMEL = r"\b[a-z][a-z0-9]*[A-Z][A-Za-z0-9_]*\b"
SNAKE = r"\b[a-z][a-z0-9_]*_[a-z0-9_]+\b"
REPOSITORY = r"(?:repo|repository|codebase|code ?base|project)"
INTENTS = (
    ("review", r"^\s*(?:please\s+|can you\s+|could you\s+)?(?:code\s+)?review\b|\breview (?:my|the|this|these|your) (?:changes?|diffs?|prs?|pull requests?|patch|work|commits?|branch|edits?|changeset)\b"),
    ("orient", r"\b(?:orient me|get me oriented|help me get oriented|where (?:do|should) i start"
        rf"|(?:understand|navigate|explore|tour|walk me through|walk through|explain|describe|give me (?:an? )?(?:overview|tour) of) (?:this|the|our) {REPOSITORY}"
        rf"|(?:overview|tour|structure|layout|shape|high[- ]level (?:overview|view)) of (?:this|the|our) {REPOSITORY}"
        rf"|(?:what is|what's|what does) (?:this|the) {REPOSITORY}(?: do| contain| look like)?"
        rf"|how (?:is|are) (?:this|the|our) {REPOSITORY} (?:structured|organized|organised|laid out|set up|put together))\b"),
    ("callers", r"\b(?:callers?|who calls|what calls|called by|usage of|usages of|references? to|where is .* used|where is .* called)\b"),
    ("callees", r"\b(?:callees?|what does .* call|calls from|outgoing calls|dependencies of)\b"),
    ("packages", r"\b(?:packages|modules?|topology|dependency graph|import graph|package layout)\b"),
    ("architecture", r"\b(?:architecture|how does .* work|overview|big picture|design of|walk me through|how is .* organized)\b"),
    ("editing", r"\b(?:edit|modify|refactor|rename|extend|fix|patch|implement|add)\b"),
)


def identifiers(text: Column) -> Column:
    """The names in a question: qualified ones, then what is left in Pascal, camel and snake case; else the whole question
    if it is one word of 3 to 32 letters."""
    rest = F.regexp_replace(text, QUALIFIED, " ")
    found = F.array_distinct(F.concat(*(F.regexp_extract_all(x, F.lit(f"({p})"), F.lit(1)) for x, p in ((text, QUALIFIED), (rest, PASCAL), (rest, CAMEL), (rest, SNAKE)))))
    return F.when(F.size(found) > 0, found).when(F.trim(text).rlike("^[A-Za-z0-9_]{3,32}$"), F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))


def intent(text: Column) -> Column:
    """The first intent whose pattern the question has; else symbol for up to three words with a name, else behavior."""
    lower, out = F.lower(text), None
    for name, pattern in INTENTS:
        out = F.when(lower.rlike(pattern), name) if out is None else out.when(lower.rlike(pattern), name)
    words = F.size(F.array_remove(F.split(text, r"\s+"), ""))
    return out.when((F.size(identifiers(text)) > 0) & words.between(1, 3), "symbol").otherwise("behavior")


def selected(nodes: DataFrame, selectors: str) -> DataFrame:
    """Nodes that fit all of field:pattern selectors; none at all is an error."""
    parts = [SELECTOR.match(x) for x in selectors.split()]
    if not parts or not all(parts):
        raise ValueError(f"not a selector: {selectors!r}")
    for m in parts:
        name, pattern = m.groups()
        if name == "kind":
            nodes = nodes.where(F.col("kind").isin(pattern.split(",")))
            continue
        column = {"func": "name", "name": "name", "pkg": "package", "file": "file", "path": "file"}[name]
        if name == "func":
            nodes = nodes.where(F.col("kind").isin("function", "method"))
        nodes = nodes.where(F.col(column).ilike(glob_to_like(pattern, substring=True)))
    return nodes


def candidates(nodes: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Names that contain the text (its % and _ stand for anything) but are not it, the shortest first. A report."""
    n = nodes.select("name").distinct().where(F.col("name").ilike(f"%{text}%") & (F.lower("name") != text.lower()))
    return n.orderBy(F.length("name"), "name").limit(k)


@dataclass
class Graph:
    """What pipes work on."""

    nodes: DataFrame
    edges: DataFrame
    ranks: DataFrame
    steps: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, step: Callable[[Graph, DataFrame, int], DataFrame]) -> None:
        """Adds a transform: it takes the graph, a table of ids and a number, and returns a table of ids."""
        self.steps[name] = step


def _step(g: Graph, ids: DataFrame, name: str, n: int) -> DataFrame:
    seeds = ids.select(F.col("id").alias("seed"))
    if name in g.steps:
        return g.steps[name](g, ids, n)
    if name == "callers":
        return graph.reach(g.edges, seeds, 1, reverse=True).select("id").distinct()
    if name == "callees":
        return graph.reach(g.edges, seeds, 1).select("id").distinct()
    if name == "impact":
        return graph.reach(g.edges, seeds, n or 3, reverse=True).select("id").distinct()
    if name == "top":
        return ids.join(g.ranks, "id").orderBy(F.round("rank", 9).desc(), "id").limit(n or 10).select("id")
    if name == "package":
        return g.nodes.join(g.nodes.join(ids, "id", "left_semi").select("package").distinct(), "package", "left_semi").select("id")
    raise ValueError(f"no such step: {name}")


def pipe(g: Graph, text: str) -> DataFrame:
    """seed | transform | terminal: selectors, then steps (name or name:n), then count or the nodes found."""
    seed, *steps = (x.strip() for x in text.split("|"))
    ids = selected(g.nodes, seed).select("id") if lane(seed) == "selector" else g.nodes.where(bare_name(F.col("name")) == seed).select("id")
    for s in steps:
        name, _, n = s.partition(":")
        if name == "count":
            return ids.agg(F.count("*").alias("count"))
        ids = _step(g, ids, name, int(n) if n else 0)
    return g.nodes.join(ids, "id", "left_semi").select("id", "name", "package", "file", "kind")


def fan_out(roots: dict[str, DataFrame], ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same question of several roots: the rows of all, with turn and root in the order of the roots, not merged."""
    out = None
    for turn, (root, df) in enumerate(roots.items()):
        part = ask(df).withColumn("turn", F.lit(turn)).withColumn("root", F.lit(root))
        out = part if out is None else out.unionByName(part)
    return out


def refs(rows: DataFrame, kind: str, path: str, provenance: str) -> DataFrame:
    """Results of any lane in one form: kind, id, path, first and last line, and where they come from."""
    return rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col(path).alias("path"), F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.lit(provenance).alias("prov"))


def symbol_shape(text: Column) -> Column:
    """Whether the input is one name, maybe qualified, with a receiver or with ()."""
    return text.rlike(r"^\(?\*?[A-Za-z_][A-Za-z0-9_]*\)?([.:]+[A-Za-z_][A-Za-z0-9_]*)*(\(\))?$")
