"""Connected components of a table of links, by alternating stars (DataFrame functions only, but for forest())."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _smallest(edges: DataFrame) -> DataFrame:
    """u and the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))


def _starry(e: DataFrame) -> bool:
    """Whether the links (u, v) are stars: each u has one v, which is no u."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    n = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
    return n.where("up > 1 OR (up = 1 AND low = 0)").isEmpty()


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links (u, v) of one task: each node and the least node that it reaches through them."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
    names, ends = np.unique(np.concatenate(u + v), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(names))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # both are roots
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    for at in range(0, len(names), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 50_000]), pa.array(names[root[at : at + 50_000]])], ["u", "v"])


def components(edges: DataFrame, purpose: str = "components", together: int = 0) -> DataFrame:
    """(node, root) for each node of the links (u, v), root being the least node that it reaches.

    With `together`, tasks of about so many links each replace them by a forest() first, which has no more links than
    nodes and connects the same: links that one task holds are done by that, whatever the size of their groups.

    A large star links the greater neighbours of each node to the least one, a small star the others; both keep what is
    connected, and every round at least halves the depth, until only stars are left. No node's links meet in one task but in
    joins, which can split. Each round is written to the shared folder. Nulls in u or v are no links; no links give no rows.
    """
    trees = None
    if together:
        edges = edges.select("u", "v").where("u <> v")
        tasks = -(-edges.count() // together) or 1
        edges = trees = written(edges.coalesce(tasks).mapInArrow(forest, "u long, v long"), purpose)
        if tasks == 1:
            return trees.select(F.col("u").alias("node"), F.col("v").alias("root"))
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, purpose)
    if trees is not None:
        dropped(trees)
    while not _starry(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = _smallest(large)
        small = large.join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select(F.col("_u").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small, purpose)
        dropped(e)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def stars(comps: DataFrame) -> DataFrame:
    """Links (u, v) that connect what is connected in comps (node, root), no more than it has nodes."""
    return comps.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def labelled(rows: DataFrame, key: str, comps: DataFrame) -> DataFrame:
    """rows with root: that of the component of column `key`, or the key itself where it has no link."""
    c = comps.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(c, F.col(key) == F.col("_node"), "left").withColumn("root", F.coalesce("_root", key)).drop("_node", "_root")


def crowded(lists: DataFrame) -> DataFrame:
    """Of lists (key, node, root): _key, members, most (largest number of members of one component) of those with members of several components."""
    sizes = lists.groupBy("key", "root").agg(F.count("*").alias("n"))
    out = sizes.groupBy("key").agg(F.sum("n").alias("members"), F.max("n").alias("most"), F.count("*").alias("roots")).where("roots > 1")
    return out.select(F.col("key").alias("_key"), "members", "most")


def starred(lists: DataFrame, columns: list[str], compatible) -> DataFrame:
    """Pairs (u, v) of two centers of each list with its other members.

    Centers are the members with the least and the greatest hash, so that in many lists a group of near copies meets
    different ones, and is connected without forming its pairs. `compatible` is a condition on columns that begin with
    a. and b., of which `columns` are at hand.
    """
    one = F.struct(F.xxhash64("node", F.lit(7)).alias("h"), "node", *columns)
    center = lists.groupBy("key").agg(F.min(one).alias("x"), F.max(one).alias("y")).where("x.node <> y.node")
    center = center.select("key", F.explode(F.array("x", "y")).alias("c")).select("key", "c.node", *(f"c.{c}" for c in columns))
    pairs = center.alias("a").join(lists.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") != F.col("b.node")) & compatible)
    return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def spread(lists: DataFrame, centers: int, seed: int, compatible) -> DataFrame:
    """Pairs (u, v) of some `centers` members of each crowded list with its members of other components.

    Lists with so few rows outside their largest component that across() forms fewer pairs are left out. Which members are
    centers depends on the list and the seed, so that the members of a large group of near copies meet different ones.
    """
    many = crowded(lists).where(F.col("members") - F.col("most") > 2 * centers).select("_key", "members")
    rows = lists.join(many, F.col("key") == F.col("_key")).drop("_key")
    chosen = rows.where(F.pmod(F.xxhash64("key", "node", F.lit(seed)), F.col("members")) < centers)
    pairs = chosen.alias("a").join(rows.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & compatible)
    return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def across(lists: DataFrame, compatible) -> DataFrame:
    """Distinct pairs (u, v), u < v, of nodes that share a list (key) and are in different components (root).

    The pairs of nodes that are connected already are never formed: of each list, the rows outside its largest
    component meet the others. `compatible` is a condition on the columns a.* and b.*, tested inside the join.
    """
    sizes = lists.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    main = main.select(F.col("key").alias("_key"), F.col("most.root").alias("main"))
    rows = lists.join(main, F.col("key") == F.col("_key")).drop("_key")
    a, b = rows.where("root <> main").alias("a"), rows.alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    pairs = a.join(b, met & compatible)
    return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
