"""Removal of repeated byte strings, and of repeated passages of words, by bucket-pointer refinement.

A position's bucket for 2m units is made of its bucket for m units and the bucket m units later, so that each round reuses
what the round before found, from single units on. So that not every suffix is sorted across the cluster, the starts of
whole strings of `length` units are grouped by the least of the buckets for `gram` units inside: consecutive starts with
the same least bucket are a region. Equal strings lie in regions of the same bucket, whatever surrounds them. Regions
whose bucket is alone are done. Regions equal as a whole repeat as a whole. What remains, regions of a shared bucket with
different ends, is cut into regions of up to `step` starts at equal distances from the least bucket, whose own buckets are
those of the string that all their starts share; these are judged alike, and what remains of them is refined to single
starts. Buckets are 64-bit hashes, sorted and grouped by Spark.

Two kinds of units: bytes, where strings of 400 repeat anywhere, also in the same document; and words, where passages of
51 (more than 50) repeat in another document.

Nulls and ties: a null text is empty; texts shorter than a string lose nothing; equal rows are each other's
repetition as to bytes; rows that share a doc_id are documents of their own; texts of any length are scanned in overlapping
pieces of bounded size. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

PIECE = 1 << 18


class Unit(NamedTuple):
    """What strings are made of: their length, that of the buckets that are compared, of the starts of a cut region, of the
    longest buckets (a power of 2), and whether only strings of different documents are repetitions."""

    name: str
    length: int
    gram: int
    step: int
    top: int
    across: bool


BYTE_STRINGS, WORD_PASSAGES = Unit("bytes", 400, 64, 16, 256, False), Unit("words", 51, 8, 4, 32, True)
LENGTH = BYTE_STRINGS.length
_rng = np.random.default_rng(20240101)
BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def refined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Buckets of pairs of buckets."""
    x = a ^ (a >> np.uint64(31))
    x *= A
    x += b * B
    return x


def units_of(data: bytes, unit: Unit) -> np.ndarray:
    """The text's units as buckets."""
    if unit.name == "bytes":
        return BYTES[np.frombuffer(data, np.uint8)]
    words = data.split()  # between ASCII white space
    known = {w: xxhash.xxh64_intdigest(w) | 1 for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def buckets(h: np.ndarray, unit: Unit) -> dict[int, np.ndarray]:
    """Buckets of all positions for 1, 2, 4, ... units; only those for gram and top units are kept."""
    m, out = 1, {}
    while True:
        if m in (unit.gram, unit.top):
            out[m] = h
        if m == unit.top or len(h) <= m:
            return out
        h = refined(h[:-m], h[m:])
        m *= 2


def finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * A
    return x ^ (x >> np.uint64(29))


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """Where the least key of each window is, the first if there are several."""
    low = (keys & ~np.uint64(0xFFFFF)) | np.arange(len(keys), dtype=np.uint64)
    m = 1
    while 2 * m <= width:
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    if m < width:
        low = np.minimum(low[: m - width], low[width - m :])
    return (low & np.uint64(0xFFFFF)).astype(np.int64)


def regions(pieces: list[np.ndarray], unit: Unit) -> tuple[np.ndarray, ...]:
    """Of each region in texts that together have less than a million units: text, first start, number of starts, distance
    to the least bucket, bucket, and hash of the whole region."""
    data, length = np.concatenate(pieces), unit.length
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    nothing = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return nothing
    h = buckets(data, unit)
    at = least_places(finished(h[unit.gram]) if unit.across else h[unit.gram], length - unit.gram + 1)
    text = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
    valid = np.arange(len(at)) + length <= ends[text]
    where = np.flatnonzero(valid)
    if not len(where):
        return nothing
    new = np.concatenate(([True], (at[where[1:]] != at[where[:-1]]) | (text[where[1:]] != text[where[:-1]])))
    first = np.flatnonzero(new)
    begin, count = where[first], np.diff(np.append(first, len(where)))
    return text[begin], begin - (ends - sizes)[text[begin]], count, at[begin] - begin, finished(h[unit.gram][at[begin]]), whole(h[unit.top], begin, count - 1 + length, unit)


def whole(top: np.ndarray, begin: np.ndarray, length: np.ndarray, unit: Unit) -> np.ndarray:
    """Hashes of strings of one to three times unit.top units from the buckets for these."""
    return finished(refined(refined(top[begin], top[begin + np.minimum(unit.top, length - unit.top)]), top[begin + length - unit.top]) + length.astype(np.uint64))


def cut_regions(pieces: list[np.ndarray], counts: np.ndarray, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """The regions (given by their units, numbers of starts and distances to the least bucket) cut at distances that step
    divides: piece, first start, number of starts, bucket of what all starts share, and hash of the whole."""
    data = np.concatenate(pieces)
    base = np.cumsum([0, *map(len, pieces)])[:-1]
    top = buckets(data, unit)[unit.top]
    piece = np.repeat(np.arange(len(pieces)), counts)
    start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    block = (at[piece] - start) // unit.step
    first = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (block[1:] != block[:-1]))))
    n = np.diff(np.append(first, len(piece)))
    piece, begin, block = piece[first], start[first], block[first]
    shared = base[piece] + at[piece] - block * unit.step
    return piece, begin, n, whole(top, shared, np.full(len(first), unit.length - unit.step + 1), unit), whole(top, base[piece] + begin, n - 1 + unit.length, unit)


def starts(pieces: list[np.ndarray], unit: Unit) -> np.ndarray:
    """The buckets for whole strings of all starts of the pieces, one after the other."""
    data = np.concatenate(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    top = buckets(data, unit)[unit.top]
    text_end = np.repeat(np.cumsum(sizes), sizes)[: len(data) - unit.length + 1]
    where = np.flatnonzero(np.arange(len(text_end)) + unit.length <= text_end)
    return finished(refined(top[where], top[where + unit.length - unit.top]))


def cut(data: np.ndarray, unit: Unit) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces that together have each start of the text once."""
    for at in range(0, max(1, len(data) - unit.length + 1), PIECE):
        yield at, data[at : at + PIECE + unit.length - 1]


NAMES = ["bucket", "whole", "row", "lo", "n", "at", "asks"]
FOUND = "bucket long, whole long, row long, lo long, n int, at int, asks boolean"


def _ints(x: np.ndarray, kind=np.int64) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(kind))


def _scan(unit: Unit):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            text, lo, n, at, bucket, hashes = regions([p for _, _, p in held], unit)
            rows, bases = np.array([r for r, _, _ in held], np.int64), np.array([b for _, b, _ in held], np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([_ints(bucket), _ints(hashes), _ints(rows[text]), _ints(lo + bases[text]), _ints(n, np.int32), _ints(at, np.int32), pa.array(np.ones(len(n), bool))], NAMES)

        held, size = [], 0
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if data is None or len(data) < unit.length:
                    continue
                for base, piece in cut(units_of(data, unit), unit):
                    if len(piece) < unit.length:
                        continue
                    held.append((row, base, piece))
                    size += len(piece)
                    if size >= PIECE:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return scan


def _parts(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[tuple[int, list[dict], list[np.ndarray]]]:
    """Some regions of one text at a time, with their units."""
    for batch in batches:
        for row, data, parts in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
            own_units = np.frombuffer(data, np.uint8) if unit.name == "bytes" else units_of(data, unit)
            for i in range(0, len(parts), 300):
                own = parts[i : i + 300]
                pieces = [own_units[p["lo"] : p["lo"] + p["n"] - 1 + unit.length] for p in own]
                yield row, own, [BYTES[x] for x in pieces] if unit.name == "bytes" else pieces


def _cut(unit: Unit):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own, pieces in _parts(batches, unit):
            lo, n, at, asks = (np.array([p[k] for p in own]) for k in ("lo", "n", "at", "asks"))
            piece, begin, count, bucket, hashes = cut_regions(pieces, n, at, unit)
            yield pa.RecordBatch.from_arrays([_ints(bucket), _ints(hashes), _ints(np.full(len(piece), row)), _ints(lo[piece] + begin), _ints(count, np.int32), _ints(at[piece] - begin, np.int32), pa.array(asks[piece])], NAMES)

    return scan


def _single(unit: Unit):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own, pieces in _parts(batches, unit):
            keys = starts(pieces, unit)
            lo, n, asks = (np.array([p[k] for p in own]) for k in ("lo", "n", "asks"))
            begin = np.repeat(lo, n) + np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
            one = np.ones(len(keys))
            yield pa.RecordBatch.from_arrays([_ints(keys), _ints(keys), _ints(np.full(len(keys), row)), _ints(begin), _ints(one, np.int32), _ints(one, np.int32), pa.array(np.repeat(asks, n))], NAMES)

    return scan


def covered(parts: list[dict], length: int) -> np.ndarray:
    """begin and end of each maximal run of units that strings starting in the parts cover."""
    ranges = np.array(sorted((p["lo"], p["lo"] + p["n"] - 1 + length) for p in parts), np.int64).reshape(-1, 2)
    if not len(ranges):
        return ranges
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.concatenate(([True], ranges[1:, 0] > reach[:-1]))
    return np.stack([ranges[first, 0], np.append(reach[:-1][first[1:]], reach[-1])], 1)


KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passage_words", "n_passages"]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, data, parts, passages in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            data = data or b""
            runs = covered(parts or [], LENGTH)
            kept, at = [], 0
            for begin, end in runs.tolist():
                kept.append(data[at:begin])
                at = end
            kept = b"".join([*kept, data[at:]])
            words = covered(passages or [], WORD_PASSAGES.length)
            out.append((doc_id, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, int((words[:, 1] - words[:, 0]).sum()), len(words)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], RESULT)


def judged(found: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """Of regions: those (row, lo, n) that ask and occur again as a whole; and, by row, the parts that remain, which are
    regions that are alone in a bucket of several, and of each other kind there one, or one of each of two documents, to be
    found but not to ask."""
    place = F.struct("row", "lo", "n", "at")
    kinds = found.groupBy("whole").agg(F.count("*").alias("times"), F.max("asks").alias("asks"), F.min("bucket").alias("bucket"), F.min(place).alias("place"), F.max(place).alias("other"))
    again = (F.col("place.row") < F.col("other.row")) if unit.across else (F.col("times") > 1)
    kinds = written(kinds.withColumn("again", again), "kinds")
    repeated = kinds.where("again AND asks").select(F.col("whole").alias("_whole"))
    alike = written(found.where("asks").join(repeated, F.col("whole") == F.col("_whole")).select("row", "lo", "n"), "repeats")
    alone = ~F.col("again") & F.col("asks")
    mixed = kinds.groupBy("bucket").agg(F.count("*").alias("_kinds"), F.max(alone).alias("_open")).where("_kinds > 1 AND _open").withColumnRenamed("bucket", "_bucket")
    rest = kinds.join(mixed, F.col("bucket") == F.col("_bucket"))
    places = F.when(F.col("again") & F.lit(unit.across), F.array("place", "other")).otherwise(F.array("place"))
    rest = rest.select(F.explode(places).alias("place"), alone.alias("asks"))
    rest = rest.select(F.col("place.row").alias("_row"), F.struct("place.lo", "place.n", "place.at", "asks").alias("part"))
    rest = written(rest.groupBy("_row").agg(F.collect_list("part").alias("parts")), "parts")  # bounded by the text's length
    dropped(kinds)
    dropped(found)
    return alike, rest


def repeated(d: DataFrame, unit: Unit) -> DataFrame:
    """_row and parts (lo, n): the starts of the strings of rows (row, doc_id, text) that repeat."""
    alike, rest = judged(written(d.mapInArrow(_scan(unit), FOUND), "regions"), unit)
    for refine in (_cut, _single):
        own = d.join(rest, F.col("row") == F.col("_row")).select("row", "doc_id", "text", "parts")
        more, rest = judged(written(own.mapInArrow(refine(unit), FOUND), "regions"), unit)
        alike = alike.unionByName(more)
    # Bounded by the text's length.
    return alike.groupBy("row").agg(F.collect_set(F.struct("lo", "n")).alias("parts")).withColumnRenamed("row", "_row")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each document; and
    n_passage_words and n_passages, the words and maximal runs of passages of more than 50 words that another document
    has too (they stay)."""
    d = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    strings = repeated(d, BYTE_STRINGS)
    passages = repeated(d, WORD_PASSAGES).select(F.col("_row").alias("_row2"), F.col("parts").alias("passages"))
    out = d.join(strings, F.col("row") == F.col("_row"), "left").join(passages, F.col("row") == F.col("_row2"), "left").select("row", "doc_id", "text", "parts", "passages")
    return out.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passage_words long, n_passages long")
