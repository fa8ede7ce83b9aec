"""WARC archives of pages with a two-level capture index.

Pages are written as WARC/1.1 records, each a gzip member of its own, to archive files; every capture has an index line
of its reversed-host URL key, page_id and place. Index lines, dealt by ranges of key and sorted, form compressed blocks;
each index file ends with its part of the sparse directory, the first key and the place of each block, and only the first
key of each file is held in memory. A lookup takes a binary search for the file, one range read of its directory, a binary
search in that, one range read of a block, a binary search in it, and one range read of the record. read_archives() looks
up all keys in that way.

Of records with equal payloads of at least REVISIT bytes the one with the largest page_id is the response and the others
are revisits without payload; smaller ones are responses.

Nulls and ties: a null html has an empty payload, a null url the key "" and no target URI; rows that share page_id and
html are records of their own, of which the first written is the response (a later one revisits that page_id, which is
its own); a null page_id counts as the least. An empty table gives no archive and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files
from .common import shared_dir

REVISIT, BLOCK_LINES, ARCHIVE_BYTES, SALTS, HELD_BLOCKS = 1000, 512, 1 << 27, 32, 4
#: Fixed values of the WARC standard.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """The URL with its host reversed: http://www.example.org:80/a?b gives org,example,www:80)/a?b, in lower case up to the path."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, _, port = rest[:cut].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:] or "/")


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def with_types(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (the response's page_id for a revisit).

    The response of each large payload comes from an aggregate by digest. It is copied SALTS times, so that equal payloads,
    however many, are dealt to as many tasks in the join.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(payload(F.col("html"))))
    d = p.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= least)
    last = d.groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    last = last.select(F.col("payload_digest").alias("_digest"), "_last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    p = p.withColumn("_own", salt).join(last, (F.col("payload_digest") == F.col("_digest")) & (F.col("_own") == F.col("_salt")), "left")
    return p.withColumn("refers_to", F.when((F.col("_last") != F.coalesce("page_id", F.col("_last") - 1)), F.col("_last"))).drop("_digest", "_last", "_salt", "_own")


def record(page_id: int | None, url: str | None, data: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record as one gzip member. The digest header has the standard's base32 form; the block is an HTTP response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"\r\n" if refers_to is not None else b"Content-Length: %d\r\n\r\n" % len(data) + data)
    lines = [
        VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {url}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Payload-Length: {len(data)}"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def parsed(member: bytes) -> dict:
    """What a record says: headers in lower case, and its payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = rest[: int(out["content-length"])]
    if len(block) != int(out["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut")
    return out | {"payload": block.partition(b"\r\n\r\n")[2]}


def _of(urn: str | None) -> int | None:
    name = (urn or "None").rpartition(":")[2].rstrip(">")
    return None if name == "None" else int(name)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all pages; returns their index lines (key, page_id, path, begin, length), a table in the folder."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, uri = None, ""
        try:
            for d in parts:
                rows = []
                for p in d.itertuples(index=False):
                    if out is None or out.at > ARCHIVE_BYTES:
                        if out:
                            out.close()
                        uri = files.fresh(folder, "pages") + ".warc.gz"
                        out = files.Writer(uri)
                    page_id, refers_to = (None if pd.isna(x) else int(x) for x in (p.page_id, p.refers_to))
                    data = record(page_id, p.url, p.html.encode(), p.payload_digest, refers_to)
                    rows.append((url_key(p.url), page_id, uri, out.write(data), len(data)))
                out_rows = pd.DataFrame(rows, columns=["key", "page_id", "path", "begin", "length"])
                yield out_rows.astype({"page_id": "Int64"})
        finally:
            if out:
                out.close()

    p = with_types(pages).select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "payload_digest", F.col("refers_to").cast("string").alias("refers_to"))
    lines = p.mapInPandas(write, "key string, page_id long, path string, begin long, length long")
    lines.write.parquet(f"{folder}/lines")
    return pages.sparkSession.read.schema(lines.schema).parquet(f"{folder}/lines")


def write_index(lines: DataFrame, folder: str) -> DataFrame:
    """The two-level index: files of compressed blocks, each with its directory at the end. Returns a row for each file:
    first_key, path, begin and length of its directory, and n (captures), a table."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, out, held, directory, n = files.fresh(folder, "index"), None, [], [], 0

        def block() -> None:
            data = zlib.compress("\n".join(held).encode(), 6)
            directory.append([json.loads(held[0])[0], out.write(data), len(data)])
            held.clear()

        try:
            for d in parts:
                for r in d.itertuples(index=False):
                    out = out or files.Writer(uri)
                    held.append(json.dumps([r.key, None if pd.isna(r.page_id) else int(r.page_id), r.path, int(r.begin), int(r.length)], ensure_ascii=False))
                    n += 1
                    if len(held) == BLOCK_LINES:
                        block()
            if held:
                block()
            rows = []
            if directory:
                data = zlib.compress(json.dumps(directory, ensure_ascii=False).encode(), 6)
                rows.append((directory[0][0], uri, out.write(data), len(data), n))
        finally:
            if out:
                out.close()
        yield pd.DataFrame(rows, columns=["first_key", "path", "begin", "length", "n"])

    order = [F.col("key"), F.col("page_id").asc_nulls_first(), F.col("path"), F.col("begin")]
    d = lines.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    directory = d.mapInPandas(write, "first_key string, path string, begin long, length long, n long")
    directory.write.parquet(f"{folder}/directory")
    return lines.sparkSession.read.schema(directory.schema).parquet(f"{folder}/directory")


def _packed(path: str, begin: int, length: int) -> str:
    f = files.Reader(path)
    try:
        return zlib.decompress(f.read(begin, length)).decode()
    finally:
        f.close()


class Index:
    """Lookups by key. What is held in memory is a line for each index file, which are as many as the partitions that wrote
    them, and the last directories and blocks read."""

    def __init__(self, files_of: list[tuple]):
        self.rows = sorted(files_of)
        self.keys = [r[0] for r in self.rows]
        self.held: dict[tuple, list] = {}

    @staticmethod
    def of(directory: DataFrame) -> Index:
        return Index([tuple(r) for r in directory.select("first_key", "path", "begin", "length").collect()])

    def _read(self, path: str, begin: int, length: int, many: bool) -> list:
        if (path, begin) not in self.held:
            while len(self.held) >= HELD_BLOCKS:
                del self.held[next(iter(self.held))]
            text = _packed(path, begin, length)
            self.held[path, begin] = [json.loads(x) for x in text.split("\n")] if many else json.loads(text)
        return self.held[path, begin]

    def lines(self, key: str) -> Iterator[list]:
        """The index lines of a key, in order: key, page_id, path, begin, length."""
        at = max(0, bisect.bisect_left(self.keys, key) - 1)
        while at < len(self.rows) and self.keys[at] <= key:
            _, path, *place = self.rows[at]
            blocks = self._read(path, *place, many=False)
            b = max(0, bisect.bisect_left(blocks, key, key=lambda x: x[0]) - 1)
            while b < len(blocks) and blocks[b][0] <= key:
                rows = self._read(path, *blocks[b][1:], many=True)
                i = bisect.bisect_left(rows, key, key=lambda x: x[0])
                while i < len(rows) and rows[i][0] == key:
                    yield rows[i]
                    i += 1
                b += 1
            at += 1

    def captures(self, url: str) -> list[tuple[int | None, bytes]]:
        """page_id and payload of the captures of a URL (b"" for a revisit's own payload)."""
        out = []
        for _, page_id, path, begin, length in self.lines(url_key(url)):
            f = files.Reader(path)
            out.append((page_id, parsed(f.read(begin, length))["payload"]))
            f.close()
        return out


def read_archives(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """Reads the captures of all keys (key) through the index: keys are sorted, each is looked up by binary searches, and
    each task range-reads its records. Returns page_id, payload_bytes, payload_digest, record_type and refers_to as the
    records have them."""
    shared = directory.sparkSession.sparkContext.broadcast(Index.of(directory).rows)

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(shared.value)
        for d in parts:
            rows = [x[2:] for key in d.key for x in index.lines(key)]
            yield pd.DataFrame(rows, columns=["path", "begin", "length"])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, f = "", None
        for d in parts:
            rows = []
            for r in d.itertuples(index=False):
                if r.path != held:
                    if f:
                        f.close()
                    held, f = r.path, files.Reader(r.path)
                w = parsed(f.read(r.begin, r.length))
                kind, own = w["warc-type"], w["payload"]
                digest = base64.b32decode(w["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "response" and hashlib.sha1(own).hexdigest() != digest:
                    raise ValueError(f"{r.path} at {r.begin}: the payload does not have its digest")
                size = int(w["warc-payload-length"]) if kind == "revisit" else len(own)
                rows.append((_of(w["warc-record-id"]), size, digest, kind, _of(w.get("warc-refers-to"))))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if f:
            f.close()

    asked = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    found = asked.mapInPandas(lines, "path string, begin long, length long")
    # Records of one stretch of an archive are read together and in order.
    stretch = F.floor(F.col("begin") / (1 << 22))
    records = found.repartition("path", stretch).sortWithinPartitions("path", "begin")
    return records.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Writes the archives and the index of all pages and looks every page's key up again."""
    folder = shared_dir(pages.sparkSession, "warc")
    lines = write_archives(pages, folder)
    return read_archives(write_index(lines, folder), lines.select("key"))
