"""Toxicity by a factorization machine over hashed terms.

Each distinct word of a text gives three terms: the word and its first four and five letters. A term has a weight and a
short vector; a text's score is the logistic of the weights' sum and of the products of all pairs of vectors, so that
terms that are harmless alone can count together. Terms are scaled by the root of their number.

The model is fitted in one task on a sample of labelled rows of bounded size (SAMPLE rows, those with the least hash of
doc_id; terms in fewer than RARE of them count nothing); every row is scored. The model has a fixed size (BITS, FACTORS), so broadcasting it is safe at any scale.

Nulls and ties: null and empty texts have no terms and take the score of the bias; of labels that share a doc_id the
greatest toxic counts, null labels are no labels; without any label of either kind the score is the share of toxic
labels (0 if none). Equal rows score alike and stay. Other columns pass through untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import only, small_batches, trimmed

BITS, FACTORS, SAMPLE, EPOCHS, RARE = 20, 4, 12_000, 8, 10
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 100_000


def terms(word: str) -> tuple[int, int, int]:
    data = word.encode()
    mask = (1 << BITS) - 1
    return zlib.crc32(data) & mask, zlib.crc32(word[:4].encode(), 4) & mask, zlib.crc32(word[:5].encode(), 5) & mask


def text_terms(text: str | None) -> np.ndarray:
    return np.array([t for w in sorted(set(WORD.findall((text or "").lower()))) for t in terms(w)], np.int32)


class Model:
    """Parameters in one float32 array: a row for each term (weight, vector), and a last one for the bias."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.codes, self.sums = rows, {}, np.zeros((0, FACTORS + 2))

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        return Model(np.frombuffer(data, np.float32).reshape(-1, FACTORS + 1))

    def _learn_words(self, words: list[str]) -> None:
        """Caches, for each word, the sums over its terms of weights, vectors and squared vectors."""
        own = self.rows[np.array([terms(w) for w in words], np.int64)].astype(np.float64)
        sums = np.concatenate([own.sum(1), (own[:, :, 1:] ** 2).sum((1, 2))[:, None]], 1)
        self.codes.update(zip(words, range(len(self.codes), len(self.codes) + len(words)), strict=True))
        self.sums = np.concatenate([self.sums, sums])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.codes) > CACHE_WORDS:
            self.codes, self.sums = {}, self.sums[:0]
        docs = [sorted(set(WORD.findall((t or "").lower()))) for t in texts]
        new = [w for w in dict.fromkeys(w for d in docs for w in d) if w not in self.codes]
        if new:
            self._learn_words(new)
        sizes = np.array([len(d) for d in docs], np.int64)
        codes = np.fromiter((self.codes[w] for d in docs for w in d), np.int64, int(sizes.sum()))
        upto = np.concatenate([np.zeros((1, FACTORS + 2)), np.cumsum(self.sums[codes], 0)])
        ends = np.cumsum(sizes)
        s = upto[ends] - upto[ends - sizes]
        scale = 1 / np.sqrt(np.maximum(1, 3 * sizes))
        pairs = 0.5 * ((s[:, 1:-1] ** 2).sum(1) - s[:, -1]) * scale**2
        return 1 / (1 + np.exp(-np.clip(self.rows[-1, 0] + s[:, 0] * scale + pairs, -30, 30)))


def fitted(texts_terms: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, step: float = 0.5, decay: float = 3e-4, weight: float = 3.0, seed: int = 5) -> np.ndarray:
    """Adaptive gradient descent on the logistic loss over mini-batches; toxic rows weigh `weight` times as much."""
    rng, size = np.random.default_rng(seed), 1 << BITS
    rows = np.zeros((size + 1, FACTORS + 1), np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    rows[-1, 0] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    if not 0 < share < 1:
        return rows
    sizes = np.array([len(t) for t in texts_terms])
    often = np.zeros(size, np.int32)
    for t in texts_terms:
        often[np.unique(t)] += 1
    often = often >= RARE
    texts_terms = [t[often[t]] for t in texts_terms]  # rarer terms would only be learned by heart
    rows[np.flatnonzero(often), 1:] = rng.normal(0, 0.02, (int(often.sum()), FACTORS))
    squares = np.full(rows.shape, 1e-2, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            ids, n = np.concatenate([texts_terms[i] for i in own]), np.array([len(texts_terms[i]) for i in own])
            doc = np.repeat(np.arange(len(own)), n)
            scale = 1 / np.sqrt(np.maximum(1, sizes[own]))
            p = rows[ids]
            upto = np.concatenate([np.zeros((1, FACTORS + 1)), np.cumsum(p, 0, dtype=np.float64)])
            ends = np.cumsum(n)
            s = upto[ends] - upto[ends - n]
            upto = np.concatenate([[0], np.cumsum((p[:, 1:] ** 2).sum(1), dtype=np.float64)])
            z = rows[-1, 0] + s[:, 0] * scale + 0.5 * ((s[:, 1:] ** 2).sum(1) - (upto[ends] - upto[ends - n])) * scale**2
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]
            error *= np.where(labels[own] > 0, weight, 1.0)
            g = np.empty_like(p)
            g[:, 0] = (error * scale)[doc]
            g[:, 1:] = (error * scale**2)[doc, None] * (s[doc, 1:] - p[:, 1:])
            which, inverse = np.unique(ids, return_inverse=True)
            total = np.stack([np.bincount(inverse, g[:, f], len(which)) for f in range(FACTORS + 1)], 1) / len(own) ** 0.5 + decay * rows[which]
            squares[which] += total**2
            rows[which] -= step * total / np.sqrt(squares[which])
            rows[-1, 0] -= step * error.mean() * 0.5
    return rows


def emptied() -> None:
    """In a Python worker: the caches of other operators and old models go back to the system before a model is fitted."""
    only("toxicity", _held.clear)
    _held.clear()
    trimmed()


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of at most `sample` labelled rows outside the held-out quarter."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
    known = known.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", F.col("_toxic").alias("toxic"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _to_terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    emptied()
    for d in parts:
        yield pd.DataFrame({"toxic": d.toxic.astype("int64"), "terms": [text_terms(t).tobytes() for t in d.text]})


def _train(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    emptied()
    d = pd.concat([*parts, pd.DataFrame({"toxic": [], "terms": []})]).sort_values(["terms", "toxic"])
    yield pd.DataFrame({"model": [fitted([np.frombuffer(t, np.int32) for t in d.terms], (d.toxic.to_numpy() > 0).astype(float)).tobytes()]})
    del d
    trimmed()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The model as bytes. Terms are taken where the texts are; one task of at most `sample` rows fits them."""
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, sample).mapInPandas(_to_terms, "toxic long, terms binary")
    models = rows.repartition(1).mapInPandas(_train, "model binary").collect()
    return models[0].model if models else fitted([], np.zeros(0)).tobytes()


_held: dict[int, Model] = {}


def scores(text: Column, model: bytes, spark) -> Column:
    """The score of each text, 0 to 1."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only("toxicity", _held.clear)
        trimmed()
        data = shared.value
        key = zlib.crc32(data)
        if key not in _held:
            _held.clear()
            _held[key] = Model.from_bytes(data)
        for texts in parts:
            out = [_held[key].scores(texts.iloc[i : i + 500].tolist()) for i in range(0, len(texts), 500)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, score and predicted (in place of columns of these names)."""
    model = fit(docs, labels, sample)
    out = docs.withColumn("score", scores(F.col("text"), model, docs.sparkSession))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", held_out(F.coalesce("doc_id", F.lit(0))))


def civil_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The documents that score below the threshold, with the columns of docs."""
    model = fit(docs, labels, sample)
    return docs.where(scores(F.col("text"), model, docs.sparkSession) < threshold)
