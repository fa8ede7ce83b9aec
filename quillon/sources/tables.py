"""Tables as sources and sinks: upserts by key, replaced columns, caches by content, views, dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def embed_text(chunks: DataFrame) -> Column:
    """What is embedded of a chunk: kind, path and content."""
    return F.concat_ws("\n", "kind", "path", "content")


def cached(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """rows with the cache's columns of the same key, and whether there was an entry (hit)."""
    c = cache.withColumn("hit", F.lit(True))
    return rows.join(c, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    n = nodes.select(F.col("id").alias("_id")).distinct()
    return edges.join(n, F.col("src") == F.col("_id"), "left_semi").join(n, F.col("dst") == F.col("_id"), "left_semi")


def without_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows whose path does not begin with the prefix, taken literally and by case."""
    return rows.where(~F.startswith("path", F.lit(prefix)))


def upserted(old: DataFrame, new: DataFrame, stamp: int) -> DataFrame:
    """The next table of (id, hash, seen): new rows replace old ones; equal hashes are only touched. action says what happened."""
    o = old.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("seen").alias("_seen"))
    j = new.join(o, F.col("id") == F.col("_id"), "full")
    action = F.when(F.col("id").isNull(), "kept").when(F.col("_id").isNull(), "inserted").when(F.col("hash") == F.col("_hash"), "touched").otherwise("updated")
    return j.select(F.coalesce("id", "_id").alias("id"), F.coalesce("hash", "_hash").alias("hash"), F.when(F.col("id").isNull(), F.col("_seen")).otherwise(F.lit(stamp)).cast("long").alias("seen"), action.alias("action"))


def replaced(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of the updates where there is one of the same key."""
    u = updates.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = rows.join(u, F.col(key) == F.col("_key"), "left")
    return j.select(*(F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def dump_prefix(rows: DataFrame, order: str, budget: int, block: int = 1024) -> DataFrame:
    """Rows (n, the size) in order as long as their running sum (used) stays within the budget.

    The running sum is that of blocks of the order's values plus that within the block, so that no task orders all rows.
    """
    r = rows.withColumn("_block", F.floor(F.col(order) / block))
    before = Window.partitionBy(F.lit(1)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    b = r.groupBy("_block").agg(F.sum("n").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = r.join(b.where(F.col("_before") <= budget), "_block")
    return own.withColumn("used", F.col("_before") + F.sum("n").over(inner)).where(F.col("used") <= budget).drop("_block", "_before")


def stale(now: DataFrame, before: DataFrame) -> DataFrame:
    """path and whether its hash differs from that of the summary that was made before."""
    return now.join(before.select("path", F.col("hash").alias("_hash")), "path").select("path", (F.col("hash") != F.col("_hash")).alias("stale"))


def latest(rows: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Of rows that share the keys, the one with the greatest stamp."""
    rest = [c for c in rows.columns if c not in (*keys, stamp)]
    return rows.groupBy(*keys).agg(F.max(F.struct(stamp, *rest)).alias("_x")).select(*keys, "_x.*").select(*rows.columns)


def next_stamp(rows: DataFrame, now: int) -> DataFrame:
    """One row: stamp, later than every one seen."""
    return rows.agg(F.greatest(F.lit(now).cast("long"), F.coalesce(F.max("seen"), F.lit(0)) + 1).alias("stamp"))


def rebuilt(old: DataFrame, new: DataFrame, stamp: int) -> DataFrame:
    """The next graph table (id, hash, seen): new rows put in and what they lack pruned; an empty extraction keeps the old."""
    if new.isEmpty():
        return old
    return upserted(old, new, stamp).where(F.col("seen") >= stamp).drop("action")
