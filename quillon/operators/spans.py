"""Joins of spans of lines (file, start_line, end_line) by blocks of 2 ** level lines: equality joins of a few rows for each
span and point, in place of all pairs of a file. Lines are 0 or more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _up(x: Column, level: Column) -> Column:
    """The block of a level that holds line x."""
    return F.call_function("shiftright", x.cast("long"), level)


def _with_last(df: DataFrame, spans: DataFrame) -> DataFrame:
    """df with _last, the greatest line of all spans."""
    return df.join(F.broadcast(spans.agg(F.max(F.greatest("start_line", "end_line").cast("long")).alias("_last"))))  # one row


def _holders(x: Column, last: Column) -> Column:
    """level and block of the blocks that hold line x, as far up as the first one that holds the lines 0 to `last`."""
    return F.transform(F.sequence(F.lit(0), F.length(F.bin(F.greatest(last, F.lit(0)) + 1))), lambda k: F.struct(k.alias("level"), _up(x, k).alias("block")))


def _parts(low: Column, high: Column) -> Column:
    """level and block of the largest blocks that make up the lines low to high, two of a level at most; none if low > high."""
    low, end = low.cast("long"), high.cast("long") + 1

    def at(k: Column) -> Column:
        a, b = _up(low - 1, k) + 1, _up(end, k)
        first, last = F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1)
        return F.transform(F.filter(F.array(first, last), lambda x: x.isNotNull()), lambda x: F.struct(k.alias("level"), x.alias("block")))

    top = F.length(F.bin(F.greatest(end - low, F.lit(1))))  # no block of more lines than there are
    return F.flatten(F.transform(F.sequence(F.lit(0), top), at))


def _before(x: Column) -> Column:
    """level and block of the blocks that make up the lines 0 to x."""
    return _parts(F.lit(0), x)


def least_around(points: DataFrame, spans: DataFrame, order: Column) -> DataFrame:
    """file, line and best: of the spans around each point (file, line), the least `order`, a struct over the columns of spans.

    A span is told to the blocks that make it up, and of each block's spans only the least is kept, as all of them hold
    each of its lines.
    """
    s = spans.where("end_line >= start_line").select("file", order.alias("best"), F.explode(_parts(F.col("start_line"), F.col("end_line"))).alias("at"))
    s = s.groupBy("file", "at.level", "at.block").agg(F.min("best").alias("best"))
    p = _with_last(points.where("line >= 0"), spans).where(F.col("line") <= F.col("_last")).select("file", "line", F.explode(_holders(F.col("line"), F.col("_last"))).alias("at")).select("file", "line", "at.level", "at.block")
    return p.join(s, ["file", "level", "block"]).groupBy("file", "line").agg(F.min("best").alias("best"))


def least_enclosing(ranges: DataFrame, spans: DataFrame, order: Column) -> DataFrame:
    """file, start_line, end_line and best: of the spans around the whole of each range, the least `order`, a struct over the
    columns of spans. Spans and ranges meet in pairs of blocks: one that holds the span's first line and lies before the
    range's, one that holds the range's last line and lies before the span's.
    """
    one = spans.groupBy("file", F.greatest("start_line", F.lit(0)).alias("low"), F.col("end_line").alias("high")).agg(F.min(order).alias("best"))
    s = _with_last(one, spans).select("file", "high", "best", F.explode(_holders(F.col("low"), F.col("_last"))).alias("a")).select("file", "best", "a", F.explode(_before(F.col("high"))).alias("b"))
    s = s.groupBy("file", "a", "b").agg(F.min("best").alias("best"))
    r = _with_last(ranges.where("start_line >= 0"), spans).where(F.col("end_line") <= F.col("_last"))
    r = r.withColumn("a", F.explode(_before(F.least("start_line", "_last")))).withColumn("b", F.explode(_holders(F.greatest("end_line", F.lit(0)), F.col("_last"))))
    return r.join(s, ["file", "a", "b"]).groupBy("file", "start_line", "end_line").agg(F.min("best").alias("best"))


def touched(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """file, low and high of the distinct ranges that any span touches."""
    r = ranges.where("low <= high").select("file", "low", "high").distinct()
    s = spans.where("start_line <= end_line").select("file", "start_line", "end_line").distinct()
    r, s = _with_last(r, spans), _with_last(s, spans)
    # One of two spans that touch begins within the other, so that a part of the other holds its first line.
    first = r.withColumn("at", F.explode(_parts(F.col("low"), F.least("high", "_last")))).join(s.select("file", F.explode(_holders(F.col("start_line"), F.col("_last"))).alias("at")).distinct(), ["file", "at"], "left_semi")
    second = r.withColumn("at", F.explode(_holders(F.col("low"), F.col("_last")))).join(s.select("file", F.explode(_parts(F.col("start_line"), F.col("end_line"))).alias("at")).distinct(), ["file", "at"], "left_semi")
    return first.unionByName(second).select("file", "low", "high").distinct()
