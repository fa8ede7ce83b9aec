"""Functions that SQL has no words for, as Arrow-batched pandas functions, and folds over the bounded lists of one text."""

from __future__ import annotations

import difflib
import json
import posixpath
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def lazily(kind: str):
    """As pandas_udf(kind), but made where it is used: a session is not needed before."""

    def wrap(f):
        def call(*columns: Column) -> Column:
            return pandas_udf(f, kind)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap


@lazily("binary")
def encoded_vector(vectors: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@lazily("array<float>")
def decoded_vector(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else np.frombuffer(d, "<f4"))


def _minified(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        json.loads(text)
    except ValueError:
        return text
    out = "".join(x if x.startswith('"') else re.sub(r"\s+", "", x) for x in re.findall(r'"(?:[^"\\]|\\.)*"|[^"]+', text))
    return out if len(out) < len(text) else text


@lazily("string")
def json_minified(text: pd.Series) -> pd.Series:
    """JSON without blanks outside strings, byte for byte else; what is no JSON, or would not be shorter, stays."""
    return text.map(_minified)


@lazily("string")
def jsonl_minified(text: pd.Series) -> pd.Series:
    """json_minified() of each line."""
    return text.map(lambda t: None if t is None else "\n".join(map(_minified, t.split("\n"))))


@lazily("string")
def resolved(folder: pd.Series, target: pd.Series) -> pd.Series:
    """A relative path from a folder, or null where it leaves the root."""

    def one(f: str | None, t: str | None) -> str | None:
        if f is None or t is None:
            return None
        path = posixpath.normpath(t.lstrip("/") if t.startswith("/") else posixpath.join(f, t))
        return None if path == ".." or path.startswith("../") else path

    return pd.Series([one(f, t) for f, t in zip(folder, target, strict=True)])


@lazily("string")
def fnv64(text: pd.Series) -> pd.Series:
    """The 64-bit FNV-1a hash in hexadecimal."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return text.map(one)


@lazily("string")
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """The diff of two texts with three lines of context, or null where it is not under 60 % of the new text or the texts are
    longer than 5000 lines."""

    def one(a: str | None, b: str | None) -> str | None:
        x, y = (a or "").split("\n"), (b or "").split("\n")
        if max(len(x), len(y)) > 5000:
            return None
        out = "\n".join(difflib.unified_diff(x, y, lineterm="", n=3))
        return out if len(out) < 0.6 * len(b or "") else None

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


@lazily("string")
def without_stale_lines(text: pd.Series) -> pd.Series:
    """A text without lines all of whose words the last three kept lines have; blank lines stay and are not counted."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        kept, last = [], []
        for line in t.split("\n"):
            words = set(line.split())
            if words and last and words <= set().union(*last):
                continue
            kept.append(line)
            if words:
                last = [*last, words][-3:]
        return "\n".join(kept)

    return text.map(one)


def fired(events: DataFrame, quiet_us: int) -> DataFrame:
    """Events (key, us, event_id) that fire: those at least `quiet_us` after the last of their key that fired. The rows of a
    key pass in order through the batches of a partition."""

    def step(parts):
        key, last = None, None
        for d in parts:
            keep = []
            for own, us in zip(d.key, d.us, strict=True):
                if own != key:
                    key, last = own, None
                keep.append(last is None or us - last >= quiet_us)
                last = us if keep[-1] else last
            yield d[keep]

    e = events.select("key", "us", "event_id").where("key IS NOT NULL")
    return e.repartition("key").sortWithinPartitions("key", "us", "event_id").mapInPandas(step, e.schema)


def byte_windows(texts: DataFrame, size: int = 4096) -> DataFrame:
    """id, place and content of windows of `size` bytes, each reaching on to the end of its last letter."""

    def cut(parts):
        for d in parts:
            rows = []
            for i, text in zip(d.id, d.content, strict=True):
                data, at, n = (text or "").encode(), 0, 0
                while at < len(data):
                    end = min(len(data), at + size)
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end += 1
                    rows.append((i, n, data[at:end].decode()))
                    at, n = end, n + 1
            yield pd.DataFrame(rows, columns=["id", "place", "content"])

    return texts.select("id", "content").mapInPandas(cut, "id long, place int, content string")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last matching rule of an ignore file leaves the path out.

    A rule that begins with ! takes in again; one that ends with / matches folders; one with a slash elsewhere is bound to the
    root; others match at any depth. What lies in a matched folder is matched.
    """
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        take, body = rule.startswith("!"), rule.removeprefix("!")
        folder, body = body.endswith("/"), body.rstrip("/")
        bound = "/" in body
        parts = re.findall(r"/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|.", body.lstrip("/"))
        name = "".join({"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, p if p.startswith("[") and len(p) > 2 else re.escape(p)) for p in parts)
        found = path.rlike(("^" if bound else "(?:^|/)") + name + ("/" if folder else "(?:/|$)"))
        out = F.when(found, not take).otherwise(out)
    return out


def narrowable(pattern: str) -> bool:
    """Whether every match of a pattern has all its plain letters in a row, so that an index of trigrams may narrow a search:
    not with folded case, alternatives, or letters that may be missing."""
    if re.search(r"\(\?[a-zA-Z]*i", pattern):
        return False
    plain = re.sub(r"\\.", "", re.sub(r"\[[^\]]*\]", "", pattern))
    return "|" not in plain and not re.search(r"[\w)][?*]|[\w)]\{0", plain)


def match_query(text: str, synonyms: dict[str, str] | None = None) -> list[list[str]]:
    """A lexical query as groups of alternatives: quoted phrases as they are, other tokens of two letters or more with the
    words that stand for them. All groups are asked for below three of them, else any (see match_all)."""
    out = []
    for phrase, token in re.findall(r'"([^"]+)"|([^\W]+)', text):
        if phrase:
            out.append([phrase])
        elif len(token) >= 2:
            out.append([token, *(synonyms or {}).get(token.lower(), "").split()])
    return out


def match_all(groups: list[list[str]]) -> bool:
    return len(groups) < 3


def bootstrap(changes: list[float], rounds: int = 2000, seed: int = 1, alpha: float = 0.05) -> tuple[float, float]:
    """The confidence interval of the mean of paired changes; a regression if its upper end is below 0."""
    if not changes:
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    x = np.asarray(changes, float)
    means = np.sort(x[rng.integers(0, len(x), (rounds, len(x)))].mean(1))
    return float(means[int(alpha / 2 * (rounds - 1) + 0.5)]), float(means[int((1 - alpha / 2) * (rounds - 1) + 0.5)])
