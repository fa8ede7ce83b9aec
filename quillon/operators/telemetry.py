"""Usage telemetry: sessions, look-ahead, rolling limits, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame) -> DataFrame:
    """Events with `part`: boundary events end a part and are dropped, so empty parts never appear."""
    w = Window.partitionBy("session").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("part", F.sum(F.when(F.col("event") == "boundary", 1).otherwise(0)).over(w)).where("event <> 'boundary'")


def session_summary(events: DataFrame) -> DataFrame:
    s = sessions(events)
    return s.groupBy("session", "part").agg(F.count("*").alias("n"), F.sum(F.when(F.col("event") == "ask", 1).otherwise(0)).alias("asks"), F.count_distinct("path").alias("paths"), ((F.max("us") - F.min("us")) / 1e6).alias("seconds"))


def opened_after(events: DataFrame, within: int = 3) -> DataFrame:
    """Each ask of a session part and whether one of the next `within` consume events has its path."""
    s = sessions(events)
    order = Window.partitionBy("session", "part").orderBy("us", "event_id")
    s = s.withColumn("c", F.sum(F.when(F.col("event") == "consume", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    asks = s.where("event = 'ask'").select("session", "part", "event_id", "path", F.explode(F.sequence(F.col("c") + 1, F.col("c") + within)).alias("c"))
    used = s.where("event = 'consume'").select("session", "part", "c", F.col("path").alias("used"))
    j = asks.join(used, ["session", "part", "c"], "left")
    return j.groupBy("session", "part", "event_id", "path").agg(F.max(F.when(F.col("used") == F.col("path"), 1).otherwise(0)).alias("opened"))


def throttle(events: DataFrame, search: Column, seconds: int = 300, hint: int = 2, reduce: int = 4, block: int = 6, group: int = 10) -> DataFrame:
    """event_id, session, calls, searches and level of each call of a session's detector.

    calls are those of the same tool and arguments (tool, path) within a rolling time, the current one included;
    searches those of all tools of the search class. A call exactly `seconds` old no longer counts. `group` searches block
    a search, whatever it is.
    """
    e = rolling_calls(events, ["session", "tool", "path"], seconds).withColumn("_s", search.cast("int"))
    w = Window.partitionBy("session").orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    e = e.withColumn("searches", F.sum("_s").over(w))
    n = F.col("calls")
    level = F.when((F.col("_s") == 1) & (F.col("searches") >= group), "block").when(n >= block, "block").when(n >= reduce, "reduce").when(n >= hint, "hint").otherwise("normal")
    return e.select("event_id", "session", "calls", "searches", level.alias("level"))


def running_share(events: DataFrame, budget: float) -> DataFrame:
    """The running sum of value of each session, its share of a budget, and whether that passes 80 and 100 percent. Sums are
    compared at nine digits: one that reaches a limit does so whatever the order of its additions."""
    w = Window.partitionBy("session").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = events.withColumn("used", F.sum(F.coalesce("value", F.lit(0.0))).over(w))
    used = F.round("used", 9)
    return s.select("event_id", "session", "used", F.when(used >= budget, "over").when(used >= 0.8 * budget, "warn").otherwise("ok").alias("state"))


def heatmap(events: DataFrame) -> DataFrame:
    """path, accesses, total value and last access."""
    return events.where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("accesses"), F.sum("value").alias("total"), F.max("us").alias("last"))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path."""
    return events.where("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("us", "event_id", "session")).alias("x")).select("path", "x.event_id", "x.session")


def open_rates(opened: DataFrame) -> DataFrame:
    return opened.groupBy("path").agg(F.count("*").alias("asks"), F.sum("opened").alias("opened"), F.avg("opened").alias("rate"))


def multiplier(rate, n, lanes):
    """How much feedback raises a result's weight, at most by half."""
    more = F.least(F.lit(0.5), 0.5 * (1 - rate) * n / (n + 20) * (lanes - 1))
    return F.when((lanes <= 1) | (n <= 0), F.lit(1.0)).otherwise(1 + more)


def shadow_report(slots: DataFrame) -> DataFrame:
    """Of each intent: slots, those where only a or only b was opened, and which of them wins."""
    g = slots.groupBy("intent").agg(F.count("*").alias("slots"), F.count_if("a_only").alias("a_only"), F.count_if("b_only").alias("b_only"))
    return g.withColumn("verdict", F.when(F.col("a_only") > F.col("b_only"), "a").when(F.col("b_only") > F.col("a_only"), "b").otherwise("tie"))


def rolling_calls(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Events with calls: how many of the same keys there were within so many seconds, the event itself included."""
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("calls", F.count("*").over(w))


def faded(weights: DataFrame, least: float, half_life: float = 604800.0) -> DataFrame:
    """Rows (weight, us) with their weight as it has decayed by the latest time of all; lesser ones are dropped."""
    now = F.broadcast(weights.agg(F.max("us").alias("_now")))  # one row
    w = weights.join(now).withColumn("weight", F.col("weight") * F.exp(-(F.col("_now") - F.col("us")) / 1e6 * F.log(F.lit(2.0)) / half_life))
    return w.where(F.col("weight") >= least).drop("_now")


def seen_again(events: DataFrame) -> DataFrame:
    """event_id, turn and seen_at of events whose path the session has had before: its turn, and that of the first time."""
    e = events.where("path IS NOT NULL").withColumn("turn", F.row_number().over(Window.partitionBy("session").orderBy("us", "event_id")).cast("long"))
    w = Window.partitionBy("session", "path")
    e = e.withColumn("seen_at", F.min("turn").over(w))
    return e.where("turn > seen_at").select("event_id", "turn", "seen_at")


def bounces(events: DataFrame, short: str, full: str) -> DataFrame:
    """path and how often a short read was followed by a full one as the session's next event on that path."""
    w = Window.partitionBy("session", "path").orderBy("us", "event_id")
    e = events.where("path IS NOT NULL").withColumn("_then", F.lead("event").over(w))
    return e.where((F.col("event") == short) & (F.col("_then") == full)).groupBy("path").agg(F.count("*").alias("bounces"))


def recent_files(events: DataFrame, dirty: Column, days: int = 14) -> DataFrame:
    """path and bonus of files of the last days: recency by half lives of two days, and a tenth for dirty ones."""
    now = F.broadcast(events.agg(F.max("us").alias("_now")))  # one row
    e = events.where("path IS NOT NULL").join(now).where(F.col("us") >= F.col("_now") - days * 86_400_000_000)
    g = e.groupBy("path").agg(F.max("us").alias("us"), F.max("_now").alias("_now"), F.bool_or(dirty).alias("_dirty"))
    return g.select("path", (0.25 * F.pow(F.lit(2.0), -(F.col("_now") - F.col("us")) / 3.6e9 / 48) + F.when(F.col("_dirty"), 0.1).otherwise(0.0)).alias("bonus"))
