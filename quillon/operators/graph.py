"""Graph analytics over nodes (id, ...) and edges (src, dst, ...) tables."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .loops import repeat, settled


def pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree and out_degree over distinct edges."""
    e = pairs(edges)
    i, o = e.groupBy("dst").agg(F.count("*").alias("in_degree")), e.groupBy("src").agg(F.count("*").alias("out_degree"))
    d = nodes.select("id").join(i, F.col("id") == F.col("dst"), "left").join(o, F.col("id") == F.col("src"), "left")
    return d.select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Call sites: src, dst and where, with names, once for each pair and site."""
    n = nodes.select("id", "name")
    e = edges.select("src", "dst", "site").distinct()
    e = e.join(n.toDF("src", "caller"), "src").join(n.toDF("dst", "callee"), "dst")
    return e.select("dst", "callee", "src", "caller", "site")


def cross_package(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and the number of other packages that call it."""
    n = nodes.select("id", "package")
    e = pairs(edges).join(n.toDF("src", "sp"), "src").join(n.toDF("dst", "dp"), "dst").where("sp <> dp")
    return e.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("sp").alias("packages"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """id and rank after a fixed number of rounds; what nodes without out-edges hold is shared by all."""
    e = pairs(edges)
    out = e.groupBy("src").agg(F.count("*").alias("n_out"))
    e = settled(e.join(out, "src"))
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    sinks = settled(ids.join(out, F.col("id") == F.col("src"), "left").select("id", F.col("src").isNull().alias("sink")))

    def step(r: DataFrame, _: int) -> DataFrame:
        lost = r.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = e.join(r.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("n_out")).alias("got"))
        r = sinks.join(got, F.col("id") == F.col("dst"), "left").join(F.broadcast(lost))
        return r.select("id", "sink", ((1 - damping) / n + damping * F.col("lost") / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))

    return repeat(sinks.withColumn("rank", F.lit(1.0 / n)), step, rounds).select("id", "rank")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """seed, id and depth (least number of hops, up to `depth`) of what each seed reaches; seeds are not in their own."""
    e = settled(pairs(edges))  # else each hop makes them anew
    e = e.select(F.col("dst").alias("a"), F.col("src").alias("b")) if reverse else e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    frontier = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth")).distinct()
    seen = frontier
    for d in range(1, depth + 1):
        new = frontier.join(e, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id"), F.lit(d).alias("depth")).distinct()
        frontier = settled(new.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def impact(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, seeds: DataFrame, depth: int = 3, per_depth: int = 8) -> DataFrame:
    """Who is affected by a change of each seed: the callers of callers, the most central of each depth first."""
    r = reach(edges, seeds, depth, reverse=True).join(ranks, "id").join(nodes.select("id", "name"), "id")
    w = Window.partitionBy("seed", "depth")
    r = r.withColumn("place", F.row_number().over(w.orderBy(F.round("rank", 9).desc(), "id"))).withColumn("more", F.greatest(F.count("*").over(w) - per_depth, F.lit(0)))
    return r.where(F.col("place") <= per_depth).select("seed", "depth", "place", "id", "name", "more")


def risk(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """seed, n (transitive callers) and level."""
    n = reach(edges, seeds, depth, reverse=True).groupBy("seed").agg(F.count("*").alias("n"))
    n = seeds.select("seed").distinct().join(n, "seed", "left").select("seed", F.coalesce("n", F.lit(0)).alias("n"))
    return n.withColumn("level", F.when(F.col("n") <= 1, "Low").when(F.col("n") <= 4, "Medium").when(F.col("n") <= 10, "High").otherwise("Critical"))


def shortest_paths(edges: DataFrame, ends: DataFrame, depth: int = 6) -> DataFrame:
    """src, dst and length of the shortest path between given ends (src, dst), or from src to all ends where there is no dst,
    if it is at most `depth` long."""
    r = reach(edges, ends.select(F.col("src").alias("seed")).distinct(), depth)
    if "dst" not in ends.columns:
        return r.select(F.col("seed").alias("src"), F.col("id").alias("dst"), F.col("depth").alias("length"))
    return ends.join(r, (F.col("src") == F.col("seed")) & (F.col("dst") == F.col("id"))).select("src", "dst", F.col("depth").alias("length"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (its least id), edges taken both ways: least labels spread, with labels of labels as shortcuts.
    Joins of the rounds are merged, as small sides would be broadcast through the driver again in each."""
    e = pairs(edges).where("src <> dst")
    e = settled(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    c = nodes.select("id", F.col("id").alias("component")).distinct()
    while True:
        got = e.join(c.select(F.col("id").alias("src"), "component").hint("merge"), "src").groupBy("dst").agg(F.min("component").alias("got"))
        new = c.join(got.hint("merge"), F.col("id") == F.col("dst"), "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("got", "component")).alias("component"))
        hop = new.select(F.col("id").alias("_id"), F.col("component").alias("further"))
        new = new.join(hop.hint("merge"), F.col("component") == F.col("_id"), "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        new = settled(new)
        if not new.where("old <> component").limit(1).count():
            return new.select("id", "component")
        c = new.select("id", "component")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (its least id) of strongly connected nodes: rounds of trimming nodes that lie on no cycle, then of
    forward and backward least labels, whose agreement at the label's own node settles a component. Joins of the rounds are
    merged: small sides would be broadcast through the driver again in each round."""
    left, done = nodes.select("id").distinct(), None
    e = settled(pairs(edges).where("src <> dst"))

    def spread(ids: DataFrame, e: DataFrame) -> DataFrame:
        c = ids.select("id", F.col("id").alias("label"))
        while True:
            got = e.join(c.select(F.col("id").alias("src"), "label").hint("merge"), "src").groupBy("dst").agg(F.min("label").alias("got"))
            new = settled(c.join(got.hint("merge"), F.col("id") == F.col("dst"), "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("got", "label")).alias("label")))
            if not new.where("old <> label").limit(1).count():
                return new.select("id", "label")
            c = new.select("id", "label")

    while True:
        while True:
            both = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).hint("merge"), "id", "left_semi")
            kept = settled(e.join(both.toDF("src").hint("merge"), "src", "left_semi").join(both.toDF("dst").hint("merge"), "dst", "left_semi"))
            same = kept.count() == e.count()
            e = kept
            if same:
                break
        if not e.limit(1).count():
            break
        ids = settled(e.select(F.col("src").alias("id")).distinct())
        forward = spread(ids, e).withColumnRenamed("label", "f")
        backward = spread(ids, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("label", "b")
        labels = forward.join(backward.hint("merge"), "id")
        found = settled(labels.where("f = b").select("id", F.col("f").alias("component")))
        done = found if done is None else done.unionByName(found)
        # Edges between nodes whose labels differ lie within no component.
        e = e.join(labels.toDF("src", "f1", "b1").hint("merge"), "src").join(labels.toDF("dst", "f2", "b2").hint("merge"), "dst").where("f1 = f2 AND b1 = b2 AND f1 <> b1").select("src", "dst")
        e = settled(e)
    if done is None:
        return left.select("id", F.col("id").alias("component"))
    return left.join(done.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component and layer of an acyclic graph's nodes: the longest path to a node that depends on nothing. Nodes on
    cycles, and those above, have none."""
    e = settled(pairs(edges).where("src <> dst"))
    ids = nodes.select("id").distinct()
    placed = settled(ids.join(e.select(F.col("src").alias("id")), "id", "left_anti").withColumn("layer", F.lit(0)))
    for layer in count(1):
        open_ids = e.join(placed.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"))
        new = e.select(F.col("src").alias("id")).distinct().join(placed, "id", "left_anti").join(open_ids, "id", "left_anti")
        new = settled(new.withColumn("layer", F.lit(layer)))
        if new.isEmpty():
            break
        placed = placed.unionByName(new)
    return placed


def spreading(edges: DataFrame, seeds: DataFrame, hops: int = 4, keep: float = 0.7, least: float = 1e-4) -> DataFrame:
    """id and score of nodes that seeds (id, score) activate over edges taken both ways: each hop, every active node
    passes on a share of its score, divided by its number of neighbours."""
    e = pairs(edges).where("src <> dst")
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = settled(e.withColumn("n", F.count("*").over(Window.partitionBy("src"))))
    a = seeds.select("id", F.col("score").cast("double").alias("score"))

    def step(a: DataFrame, _: int) -> DataFrame:
        sent = e.join(a.where(F.col("score") > least).select(F.col("id").alias("src"), "score"), "src").select(F.col("dst").alias("id"), (F.col("score") * keep / F.col("n")).alias("score"))
        return a.unionByName(sent).groupBy("id").agg(F.sum("score").alias("score"))

    return repeat(a, step, hops, every=2).join(seeds.select("id"), "id", "left_anti")


def package_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src and dst package and the number of distinct calls between them."""
    n = nodes.select("id", "package")
    e = pairs(edges).join(n.toDF("src", "from_package"), "src").join(n.toDF("dst", "to_package"), "dst")
    return e.where("from_package <> to_package").groupBy("from_package", "to_package").agg(F.count("*").alias("calls"))


def smells(symbols: DataFrame, packages: DataFrame, long: int = 80, crowded: int = 3, busy: int = 10, busy_packages: int = 3) -> DataFrame:
    """smell, subject and value: long functions, exported functions that nobody calls, files of many symbols, and
    functions with many callers or callers from many packages (packages: id, packages)."""
    f = symbols.where("kind IN ('function', 'method') AND file <> ''")
    subject = F.col("id").cast("string").alias("subject")
    spans = f.select(F.lit("long").alias("smell"), subject, (F.col("end_line") - F.col("start_line")).cast("long").alias("value")).where(F.col("value") >= long)
    dead = f.where((F.col("in_degree") == 0) & F.col("name").rlike("^[A-Z]")).select(F.lit("dead_export").alias("smell"), subject, F.col("start_line").cast("long").alias("value"))
    files = symbols.where("kind IN ('function', 'method', 'struct', 'type', 'interface') AND file <> ''").groupBy("file").agg(F.count("*").alias("value"))
    files = files.where(F.col("value") >= crowded).select(F.lit("god_file").alias("smell"), F.col("file").alias("subject"), "value")
    busy_nodes = f.join(packages, "id", "left").where((F.col("in_degree") >= busy) | (F.coalesce("packages", F.lit(0)) >= busy_packages))
    gods = busy_nodes.select(F.lit("god_node").alias("smell"), subject, F.col("in_degree").alias("value"))
    return spans.unionByName(dead).unionByName(files).unionByName(gods)


def rollup(nodes: DataFrame, ranks: DataFrame, k: int = 3) -> DataFrame:
    """The k most central nodes of each package."""
    r = nodes.join(ranks, "id")
    return r.withColumn("place", F.row_number().over(Window.partitionBy("package").orderBy(F.round("rank", 9).desc(), "id"))).where(F.col("place") <= k).select("package", "place", "id", "name")


def _per_component(nodes: DataFrame, edges: DataFrame, fn, schema: str) -> DataFrame:
    """Runs a sequential algorithm on each connected component of settled edges (src, dst) by itself."""
    c = components(nodes, edges)
    e = edges.join(c.withColumnRenamed("id", "src").hint("merge"), "src")
    return e.groupBy("component").applyInPandas(fn, schema)


def pairs_with_repeats(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src <> dst")


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and the share of shortest paths between others that pass through it; parallel edges are paths of their own.
    Shortest paths are counted from each source within its component; nodes on none are absent."""
    n, edges = nodes.select("id").distinct().count(), settled(pairs_with_repeats(edges))

    def brandes(d: pd.DataFrame) -> pd.DataFrame:
        after: dict[int, dict[int, int]] = {}
        for s, t in zip(d.src, d.dst, strict=True):
            own = after.setdefault(int(s), {})
            own[int(t)] = own.get(int(t), 0) + 1
        total: dict[int, float] = {}
        for s in sorted(after):
            far, ways, order, before = {s: 0}, {s: 1.0}, [s], {}
            for v in order:  # grows while it is read
                for w, m in after.get(v, {}).items():
                    if w not in far:
                        far[w] = far[v] + 1
                        order.append(w)
                    if far[w] == far[v] + 1:
                        ways[w] = ways.get(w, 0.0) + ways[v] * m
                        before.setdefault(w, []).append((v, m))
            held: dict[int, float] = {}
            for w in reversed(order):
                for v, m in before.get(w, []):
                    held[v] = held.get(v, 0.0) + ways[v] * m / ways[w] * (1 + held.get(w, 0.0))
                if w != s and held.get(w):
                    total[w] = total.get(w, 0.0) + held[w]
        scale = max(1, (n - 1) * (n - 2))
        return pd.DataFrame({"id": list(total), "score": [x / scale for x in total.values()]}, columns=["id", "score"]).astype({"id": "int64", "score": "float64"})

    return _per_component(nodes, edges, brandes, "id long, score double")


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and community (its least id): one level of local moving by modularity, in the order of ids, in each component.
    Edges count both ways, parallel ones add up."""
    edges = settled(pairs_with_repeats(edges))
    m = float(edges.count()) or 1.0

    def moving(d: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, dict[int, float]] = {}
        for a, b in zip(d.src, d.dst, strict=True):
            for x, y in ((int(a), int(b)), (int(b), int(a))):
                own = near.setdefault(x, {})
                own[y] = own.get(y, 0.0) + 1.0
        size = {v: sum(w.values()) for v, w in near.items()}
        home, total, moved = {v: v for v in near}, dict(size), True
        while moved:
            moved = False
            for v in sorted(near):
                ties: dict[int, float] = {}
                for w, weight in near[v].items():
                    ties[home[w]] = ties.get(home[w], 0.0) + weight
                total[home[v]] -= size[v]
                best, gain = home[v], ties.get(home[v], 0.0) - total[home[v]] * size[v] / (2 * m)
                for c in sorted(ties):
                    g = ties[c] - total[c] * size[v] / (2 * m)
                    if g > gain + 1e-10:
                        best, gain = c, g
                total[best] += size[v]
                if best != home[v]:
                    home[v], moved = best, True
        least: dict[int, int] = {}
        for v in sorted(home):
            least.setdefault(home[v], v)
        return pd.DataFrame({"id": list(home), "community": [least[c] for c in home.values()]}).astype("int64")

    return _per_component(nodes, edges, moving, "id long, community long")


def dump(df: DataFrame, path: str) -> None:
    """A JSON line for each row."""
    df.write.mode("overwrite").json(path)


