"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slot n of the mixture, which is one word long, takes the point frac((n + 1) / golden ratio). The point falls into the
interval of one source among the cumulated targets, so that every stretch of slots holds each source in about its share.
The r-th slot of a source takes the r-th of its words: the documents of a source, in hashed order, are one stream of
words; after the last word the stream begins again. There are as many slots as words, so that small sources get theirs.

Nulls and ties: a null text has size 0 and is taken 0 times; a null source is a source, sorted last; rows with equal
doc_id are rows of their own, ordered by size; an empty table gives no rows. Columns other than doc_id, text and source
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, bounded, written

#: The fractional part of the golden ratio in units of 2 ** -60, as halves of 30 bits: doubles are too coarse for billions of slots.
GOLDEN, HALF = 0x9E3779B97F4A7C1, 30
BROADCAST_ROWS, BUCKET_ROWS = 100_000, 1000
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (number of words) of each row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target, and the source's part of the unit interval [low, high).

    Targets are min(most * size, level * weight), where the level makes them sum to all sizes: what sharing the excess
    of capped sources again and again ends in. One row for each source meets in one task, no documents.
    """
    all_rows = Window.partitionBy(F.lit(1))
    by_name = all_rows.orderBy(F.col("source").asc_nulls_last())
    by_cap = all_rows.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    s = s.withColumn("weight", weight.cast("double")).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("all_weight", F.sum("weight").over(all_rows))
    # The level if just the sources up to here, by ratio, were capped; the true level is the largest of them and of no cap.
    s = s.withColumn("left", F.col("all_weight") - F.sum("weight").over(upto)).withColumn("rest", F.col("total") - F.sum("cap").over(upto))
    s = s.withColumn("next", F.lead("ratio").over(by_cap))
    level = F.try_divide("rest", "left")
    fits = (level <= F.col("next")) & (level >= F.col("ratio"))
    none = F.when(F.col("total") / F.col("all_weight") <= F.min("ratio").over(all_rows), F.col("total") / F.col("all_weight"))
    s = s.withColumn("level", F.coalesce(none, F.min(F.when(fits, level)).over(all_rows), F.max("ratio").over(all_rows)))
    s = s.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
    share = F.when(F.col("total") > 0, F.col("target") / F.sum("target").over(all_rows)).otherwise(F.lit(0.0))
    s = s.withColumn("share", share)
    s = s.withColumn("high", F.sum("share").over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.select("source", "source_size", "rows", "target", "total", (F.col("high") - F.col("share")).alias("low"), "high")


def slots(targets: DataFrame, least_cells: int = 4096) -> DataFrame:
    """slot and source of the mixture: a slot for each word of all sources. Reads targets more than once.

    Slots find their source by an equality join on cells of the unit interval.
    """
    total, sources = targets.agg(F.max("total"), F.count("*")).first()
    cells = max(least_cells, sources)
    parts = targets.where("target > 0")
    last = F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))
    parts = parts.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("low") * cells), F.lit(cells - 1)), last)))
    top = F.max("high").over(Window.partitionBy("cell"))
    parts = parts.withColumn("high", F.when((F.col("cell") == cells - 1) & (F.col("high") == top), F.lit(2.0)).otherwise(F.col("high")))
    parts = parts.select("source", "low", "high", "cell")
    n, mask = F.col("id") + 1, F.lit((1 << HALF) - 1).cast("long")
    n1, n0, g1, g0 = F.shiftright(n, HALF), n.bitwiseAND(mask), F.lit(GOLDEN >> HALF).cast("long"), F.lit(GOLDEN & ((1 << HALF) - 1)).cast("long")
    units = (F.shiftleft((n1 * g0 + n0 * g1).bitwiseAND(mask), HALF) + n0 * g0).bitwiseAND(F.lit((1 << 2 * HALF) - 1).cast("long"))
    slot = targets.sparkSession.range(total or 0).select(F.col("id").alias("slot"), (units / F.lit(float(1 << 2 * HALF))).alias("point"))
    slot = slot.withColumn("cell", F.least(F.floor(F.col("point") * cells), F.lit(cells - 1)))
    s = slot.join(F.broadcast(parts) if bounded(parts, BROADCAST_ROWS) else parts, "cell").where("point >= low AND point < high")
    return s.select("slot", "source")


def schedule(targets: DataFrame, segment: int = 1024) -> DataFrame:
    """slot, source and rank (among the slots of its source, from 0) of the mixture.

    Ranks are a running count over segments plus a rank within the segment, so that no task holds all slots of a large
    source.
    """
    s = slots(targets).withColumn("segment", F.floor(F.col("slot") / segment))
    counts = s.groupBy("source", "segment").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("of"), F.col("segment").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    s = s.withColumn("inner", F.row_number().over(Window.partitionBy("source", "segment").orderBy("slot")) - 1)
    s = s.join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("at")))
    return s.select("slot", "source", (F.col("earlier") + F.col("inner")).alias("rank"))


def streamed(sizes: DataFrame, buckets: int = 4096, seed: int = 11) -> DataFrame:
    """Adds begin: the words of the same source before the document, in hashed order (sums over buckets, a power of 2 that
    grows with the rows, then within one)."""
    d = sizes.withColumn("mixed", F.xxhash64("doc_id", F.lit(seed)))
    d = d.withColumn("bucket", F.shiftrightunsigned("mixed", 64 - (buckets.bit_length() - 1)))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = d.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    b = b.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ties = [F.xxhash64("row.text")] if "row" in sizes.columns else []
    inner = Window.partitionBy("source", "bucket").orderBy("mixed", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    d = d.join(b, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    return d.select(*sizes.columns, (F.col("earlier") + F.col("inner")).alias("begin"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the mixture takes, repeats counted) of each row."""
    return _taken(sized(docs), weights, most)


def _taken(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """mix() of sized() rows; other columns stay."""
    targets = written(source_targets(sizes, weights, most), "targets")
    # The ranks of a source's slots are 0 to their number, so the number says how often each word of its stream is taken.
    number = slots(targets).groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "has")
    t = targets.join(number, F.col("source").eqNullSafe(F.col("has")), "left")
    t = t.select(F.col("source").alias("of"), "source_size", "target", F.least(F.coalesce("n", F.lit(0)), F.col("source_size") * most).alias("n"))
    t = written(t, "targets")
    rows = targets.agg(F.max("rows")).first()[0] or 0
    d = streamed(sizes, buckets=max(4096, 1 << (rows // BUCKET_ROWS).bit_length())).join(F.broadcast(t) if bounded(t, BROADCAST_ROWS) else t, F.col("source").eqNullSafe(F.col("of")))
    size = F.greatest("source_size", F.lit(1))
    rest = F.least(F.greatest(F.col("n") % size - F.col("begin"), F.lit(0)), F.col("size"))
    taken = F.col("size") * F.floor(F.col("n") / size) + rest
    return d.select(*sizes.columns, "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The documents of the mixture, with the columns of docs: a row for each whole time that a document is taken, and
    one with its first words for what is left. Documents not taken are absent. Rows are taken as
    they are, so doc_id may be null or repeated."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # apart from the names used here
    d = _taken(docs.select("doc_id", "source", size.alias("size"), row.alias("row")), weights, most).where("taken > 0")
    d = d.select("row", F.floor(F.col("taken") / F.col("size")).alias("whole"), (F.col("taken") % F.col("size")).alias("rest"))
    whole, rest, text = F.col("whole"), F.col("rest"), F.col("row.text")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0))))
    pieces = F.split(F.regexp_replace(text, "^" + SPACES, ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.col("copy") > whole
    d = d.withColumn("cut", F.when(cut, F.array_join(F.slice(pieces, F.lit(1), rest.cast("int")), "")).otherwise(text))

    def kept(c: str):
        if c == "text":
            return F.col("cut").alias(c)
        own = F.col("row")[c]
        return F.when(cut, F.length("cut").cast("long")).otherwise(own).alias(c) if c == "n_chars" else own.alias(c)

    return d.select(*map(kept, docs.columns))
