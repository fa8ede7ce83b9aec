"""Searches made of the retrieval operators: fused, reranked and capped; clusters of clones; related files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, prose
from . import graph, retrieval
from .loops import settled

Rerank = Callable[[DataFrame], DataFrame]


def search(dense: DataFrame | None, lexical: DataFrame | None, chunks: DataFrame, k: int = 8, per_file: int = 2, rerank: Rerank | None = None) -> DataFrame:
    """qid, id, final and rank of the first k hits of each query.

    Both legs are fused; without one of them, the other stands alone (its score is final's base). Hits are reranked by
    `rerank`, which is given hits with score and the columns of chunks and returns them with final, or else locally; then
    at most `per_file` hits of a file (dir) stay.
    """
    fused = retrieval.linear_fusion(dense, lexical) if dense is not None and lexical is not None else (dense if dense is not None else lexical).select("qid", "id", "score")
    hits = (rerank or retrieval.local_rerank)(fused.join(chunks, "id"))
    order = [F.round("final", 9).desc(), F.col("id")]
    capped = hits.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "dir").orderBy(*order))).where(F.col("_n") <= per_file)
    return retrieval.top(capped, k, "qid", *order).select("qid", "id", "final", "rank")


def clone_clusters(pairs: DataFrame, least: int = 2, limit: int = 20) -> DataFrame:
    """cluster (least member), members and similarity (that of its weakest pair) of groups of similar rows (a, b,
    similarity), the largest first."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    c = graph.components(ids, pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    weakest = pairs.join(c.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.min("similarity").alias("similarity"))
    g = c.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") >= least).join(weakest, "component")
    return g.select(F.col("component").alias("cluster"), "members", "similarity").orderBy(F.col("members").desc(), F.round("similarity", 9).desc(), "cluster").limit(limit)


def related_files(links: DataFrame, seeds: DataFrame, hops: int = 3, decay: float = 0.6, k: int = 20) -> DataFrame:
    """file, score (decay ** hop of the first hop that reaches it) of the k nearest files by links (a, b), both ways."""
    both = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = front = seeds.select(F.col("file")).distinct().withColumn("score", F.lit(1.0))
    for hop in range(1, hops + 1):
        front = both.join(front.select(F.col("file").alias("a")), "a").select(F.col("b").alias("file")).distinct().join(seen.select("file"), "file", "left_anti").withColumn("score", F.lit(decay**hop))
        seen = seen.unionByName(front)
    return seen.where("score < 1").orderBy(F.col("score").desc(), "file").limit(k)


def symbol_lane(symbols: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """qid, id and rank of the symbols that a query (qid, name) names, one for each file and name."""
    j = wanted.distinct().join(symbols, "name")
    order = [F.col("rank").desc(), F.col("in_degree").desc(), F.col("start_line"), F.col("id")]
    one = j.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "file", "name").orderBy(*order))).where("_n = 1").drop("_n").withColumnRenamed("rank", "central")
    return retrieval.top(one, k, "qid", F.col("central").desc(), F.col("in_degree").desc(), F.col("start_line"), F.col("id")).select("qid", "id", "rank")


def owners(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """path and owner: of the rules (glob, owner), the last that matches; a rule without a slash matches base names, one that
    ends with a slash what lies below."""
    owner = F.lit(None).cast("string")
    for pattern, who in rules:
        if pattern.endswith("/"):
            found = F.concat(F.lit("/"), F.col("path")).contains("/" + pattern.strip("/") + "/")
        elif "/" in pattern:
            found = paths.globbed(F.col("path"), pattern.lstrip("/"))
        else:
            found = paths.globbed(paths.base(F.col("path")), pattern)
        owner = F.when(found, who).otherwise(owner)
    return files.select("path", owner.alias("owner"))


def keywords(text: Column) -> Column:
    """The distinct words of a task of three letters or more without those of little content."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: (F.length(w) >= 3) & ~w.isin(prose.FUNCTION_WORDS))
    return F.array_distinct(words)


def max_coverage(items: list[tuple[set, int]], budget: int) -> list[int]:
    """Places of items (keys, cost) in the order of most new keys for their cost, as long as the budget lasts; 0 is no bound.
    Equal gains go to the earlier item. For the bounded lists of one query."""
    covered: set = set()
    left, out = budget, []
    open_items = [i for i, (_, cost) in enumerate(items) if cost > 0]
    while True:
        gain = [(len(items[i][0] - covered) / items[i][1], -i) for i in open_items if (budget <= 0 or items[i][1] <= left) and items[i][0] - covered]
        if not gain:
            return out
        best = -max(gain)[1]
        open_items.remove(best)
        out.append(best)
        covered |= items[best][0]
        left -= items[best][1]


#: Words that stand for others in a lexical query.
SYNONYMS = {
    "auth": "authentication token jwt login session oauth credential permission middleware", "async": "await goroutine channel concurrent future promise",
    "error": "err result exception panic fault", "http": "request response handler rest json header endpoint", "db": "database sql query transaction migration schema store",
    "test": "mock fixture assert stub spec suite", "cache": "redis ttl invalidate evict memcache", "config": "configuration env settings flag option",
    "log": "logger logging trace debug warn", "deploy": "deployment release rollout version manifest", "server": "handler listener endpoint service rpc serve",
    "client": "connection dial connect transport", "stream": "channel pipe buffer reader writer", "file": "path dir directory io", "net": "network tcp udp socket conn",
    "msg": "message event payload packet", "index": "idx key lookup table", "parse": "decode unmarshal read scan lex", "encode": "marshal serialize write format",
    "compress": "compression gzip zstd deflate minify", "search": "query lookup find match rank retrieve", "embed": "embedding vector semantic similarity encode",
    "chunk": "segment block slice window split", "graph": "node edge dependency import call tree", "queue": "channel buffer fifo dequeue enqueue worker",
    "metric": "counter gauge histogram stats telemetry", "middleware": "interceptor filter handler chain wrapper",
}


def expanded(words: Column) -> Column:
    """The words with those that stand for them, each once, in order."""
    table = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.split(F.lit(v), " "))))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))))


def read_mode(tokens: Column, budget: Column) -> Column:
    """How a file of so many tokens is read within a budget: full, else its map (a fifth), its signatures (a twentieth), or a handle."""
    return F.when(tokens <= budget, "full").when(tokens / 5 <= budget, "map").when(tokens / 20 <= budget, "signatures").otherwise("handle")
