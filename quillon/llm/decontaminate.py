"""Benchmark decontamination by winnowing (DataFrame functions only).

Of the hashes of all k-grams of words in each sliding window, the least is kept as a fingerprint. Two texts that share
`window` consecutive words share the fingerprint of that window, so a join on fingerprints finds every such span; the
hits are then extended to the whole window and compared word by word. Items of fewer words than a window are one
window of their own length, found by the hash of all their words.

Nulls and ties: null and empty texts have no words and hit nothing; an item without words has no window; rows with
equal doc_id or item_id are counted together under that id; an empty benchmark hits nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BREAKS, ascii_lower, bounded, words_of

#: A benchmark with more fingerprints than this is joined by a shuffle and not broadcast.
BROADCAST_ROWS = 2_000_000


def _worded(df: DataFrame, key: str) -> DataFrame:
    d = df.select(F.col(key).alias("key"), words_of(ascii_lower(F.col("text")), BREAKS).alias("words"))
    return d.select("key", "words", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def _shifted(n: int) -> Column:
    size = F.size("hashes")
    return F.arrays_zip(*(F.slice("hashes", F.lit(i + 1), F.greatest(size - i, F.lit(0))).alias(f"w{i}") for i in range(n)))


def _windows(d: DataFrame, window: int, k: int) -> DataFrame:
    """A row for each word position, at which the least k-gram hash of the window that begins there is `print` (null if
    the text ends before); texts without words have one row."""
    d = d.select("key", "n_words", "words", F.posexplode_outer(_shifted(window)).alias("at", "w"))
    grams = [F.xxhash64(*(F.col("w")[f"w{i + j}"] for j in range(k))) for i in range(window - k + 1)]
    least = F.least(*grams) if len(grams) > 1 else grams[0]
    return d.select("key", "n_words", "words", "at", F.when(F.col("w")[f"w{window - 1}"].isNotNull(), least).alias("print"))


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if bounded(df, BROADCAST_ROWS) else df


def hits(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(key, n_words) of each document, and the hits: key, at (first word, from 0), len, item."""
    d, b = _worded(docs, "doc_id"), _worded(items, "item_id")
    span = F.slice("words", F.col("at") + 1, F.lit(window))
    prints = _windows(b, window, k).where("print IS NOT NULL").select("print", F.col("key").alias("item"), span.alias("theirs"))
    # The first row of a text stands for its number of words, so that one pass gives both.
    found = _windows(d, window, k).join(_maybe_broadcast(prints.select("print").distinct().withColumn("hit", F.lit(True))), "print", "left")
    found = found.where("at IS NULL OR at = 0 OR hit").select("key", "n_words", "at", F.when(F.col("hit"), F.col("print")).alias("print"), F.when(F.col("hit"), span).alias("ours"))
    counted = found.where("at IS NULL OR at = 0").select("key", "n_words")
    out = found.join(_maybe_broadcast(prints), "print").where("ours = theirs").select("key", "at", F.lit(window).alias("len"), "item")
    short = b.where((F.col("n_words") > 0) & (F.col("n_words") < window))
    lengths = sorted(r[0] for r in short.select("n_words").distinct().collect())  # below the window's length, so few
    for n in lengths:
        whole = F.xxhash64(*(F.col("w")[f"w{j}"] for j in range(n)))
        p = d.select("key", "words", F.posexplode(_shifted(n)).alias("at", "w")).where(F.col("w")[f"w{n - 1}"].isNotNull())
        p = p.select("key", "words", "at", whole.alias("print"))
        s = short.where(F.col("n_words") == n).select(F.col("key").alias("item"), F.col("words").alias("theirs"), F.xxhash64(*(F.col("hashes")[j] for j in range(n))).alias("print"))
        p = p.join(_maybe_broadcast(s), "print").where(F.slice("words", F.col("at") + 1, F.lit(n)) == F.col("theirs"))
        out = out.unionByName(p.select("key", "at", F.lit(n).alias("len"), "item"))
    return counted, out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any hit), n_items and items_sha256 of the items hit, contaminated."""
    counted, found = hits(docs, items, window, k)
    n_words = counted.groupBy("key").agg(F.sum("n_words").alias("n_words"))
    covered = found.select("key", "item", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)).alias("word"))
    n_hit = covered.select("key", "word").distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    ids = F.sort_array(F.collect_list(F.col("item").cast("string")))
    which = found.select("key", "item").distinct().groupBy("key").agg(F.count("item").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    hit = n_hit.join(which, "key").select(F.col("key").alias("_key"), "n_hit", "n_items", "items_sha256")
    out = n_words.join(hit, F.col("key").eqNullSafe(F.col("_key")), "left")
    return out.select(
        F.col("key").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The documents that hit no item, with the columns of docs, whatever their names. Rows that share a doc_id, null as
    well, go together."""
    _, found = hits(docs, items, window, k)
    return docs.alias("d").join(found.select("key").distinct().alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.key")), "left_anti")
