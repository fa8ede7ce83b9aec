"""Token ids in a binary format, coded by static range asymmetric numeral systems.

Documents are dealt by ranges of doc_id, encoded by a public tokenizer, closed with an end id, and written in ascending
doc_id order to segment files. A segment has one table of symbol frequencies (scaled to 2 to the 20th) that its blocks
share. A block holds up to 2 to the 20th ids in up to 2048 interleaved coder states and decodes without the others. The
segment ends with a directory of checkpoints (first id, byte range and crc32 of each block), the documents' ids and
lengths, and a footer with the directory's place and crc32. The manifest, one row a segment, orders the segments.

Nulls and ties: a null or empty text is the end id alone; rows with equal doc_id follow each other, ordered by text; a
null doc_id comes first; an empty table gives no segment and no rows. Other columns are ignored. Texts may be of any
length: a document can span blocks, and a segment is closed after the document that fills it.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import only, shared_dir, small_batches, trimmed

MAGIC = b"QRANS\x01\n\x00"
SCALE, LOW = 20, np.uint64(1 << 31)
LANES, BLOCK, SEGMENT, SLICE = 2048, 1 << 20, 1 << 23, 256
END = 0
#: Slices after which memory that is free goes back to the system.
TRIM = 4
#: White space other than space and line feed, and the mark of a text's start.
OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["\x01", "\x02"]


def uneven(text: str) -> bool:
    """Whether white space is anything but single spaces and line feeds inside, so that Encoder can't split the text."""
    return text[0].isspace() or text[-1].isspace() or any(x in text for x in ("  ", "\n\n", " \n", "\n ", *OTHER_SPACES))


#: Pieces of each of the two generations of Encoder's cache.
CACHE_PIECES = 300_000
#: Marks that are cut off the end of a piece if an ASCII letter or digit comes before.
MARKS = ".,;:!?%&*#$"
#: Of each byte, whether it is an ASCII letter or digit.
WORDS = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])


class Encoder:
    """Encodes texts by pieces between which no token of a byte-level BPE crosses: a space before a word goes with the
    word, a single line feed begins a piece. The pieces of some texts are told apart by Arrow, so that each distinct one is
    looked up once; the new ones are encoded as one text, whose ids are cut where pieces end. Marks at a piece's end are
    encoded apart if the tokenizer splits there. Of the pieces kept, those that the last CACHE_PIECES new ones came
    without go."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)  # of each id; byte-level BPE names a byte by a letter
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(token)
        added = self.tokenizer.get_added_tokens_decoder()
        for i, token in added.items():
            self.bytes[i] = len(token.content.encode())
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else lambda text: []
        apart = all([x[1] for x in split(c + MARKS)] == [(0, 1), (1, 1 + len(MARKS))] for c in "aZ0")
        self.marks = "" if not apart or any(c in token.content for token in added.values() for c in MARKS) else MARKS
        self.clear()

    def clear(self) -> None:
        """Pieces and their ids, as bytes. Pieces begin with \\x01 at the start of a text, with a line feed after one, else after a space."""
        self.codes: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _add(self, pieces: set[str]) -> None:
        if len(self.codes) + len(pieces) > CACHE_PIECES:
            self.codes, self.former = {}, self.codes
        new = []
        for p, ids in zip(pieces, map(self.former.get, pieces), strict=True):
            if ids is not None:
                self.codes[p] = ids
            else:
                new.append(p)
        if not new:
            return
        shown = ["\n" + p[1:] if p[0] in "\x01\n" else " " + p for p in new]
        ids = self._whole("".join(shown))
        ends, upto = np.cumsum(pc.binary_length(pa.array(shown, pa.string())).to_numpy(), dtype=np.int64), np.cumsum(self.bytes[ids])
        cut = np.searchsorted(upto, ends)
        if upto[-1] != ends[-1] or (upto[cut] != ends).any():
            raise ValueError("a token crosses two pieces: the tokenizer is no byte-level BPE")
        data, cut = ids.tobytes(), (4 * (cut + 1)).tolist()
        # A text's first piece has no line feed before it.
        self.codes.update((p, data[begin + 4 * (p[0] == "\x01") : end]) for p, begin, end in zip(new, [0, *cut], cut, strict=False))

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        got = list(map(self.codes.get, pieces))
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            self._add({pieces[i] for i in missing})
            for i in missing:
                got[i] = self.codes[pieces[i]]
        return got

    def _end(self, marks: str) -> bytes:
        """The ids of marks after an ASCII letter or digit."""
        if marks not in self.ends:
            ids = self._whole("a" + marks)
            if self.bytes[ids[0]] != 1:
                raise ValueError("a token crosses two pieces: the tokenizer is no byte-level BPE")
            if len(self.ends) > CACHE_PIECES:
                self.ends.clear()
            self.ends[marks] = ids[1:].tobytes()
        return self.ends[marks]

    def _cut(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """The pieces without the marks that are encoded apart; which pieces have such, and these."""
        none = np.zeros(0, np.int64)
        if not len(pieces) or not self.marks:
            return pieces, none, pa.array([], pa.large_string())
        stems = pc.utf8_rtrim(pieces, characters=self.marks)
        ends, data = np.frombuffer(stems.buffers()[1], np.int64)[1 + stems.offset :][: len(stems)], np.frombuffer(stems.buffers()[2], np.uint8)
        sizes = pc.binary_length(stems).to_numpy()
        cut = (sizes > 0) & (sizes < pc.binary_length(pieces).to_numpy()) & WORDS[data[np.maximum(ends - 1, 0)]]
        where = np.flatnonzero(cut)
        marks = pc.replace_substring_regex(pieces.take(pa.array(where)), f"(?s)^.*[^{self.marks}]", "")
        return pc.if_else(pa.array(cut), stems, pieces), where, marks

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text; both without end ids."""
        odd = {i: self._whole(text) for i, text in enumerate(texts) if text and uneven(text)}
        even = pa.array(["\x01" + ("" if i in odd else text) for i, text in enumerate(texts)], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
        pieces = split.flatten().dictionary_encode()
        stems, where, marks = self._cut(pieces.dictionary)
        stems, marks = stems.dictionary_encode(), marks.dictionary_encode()
        # Each distinct piece is a stem and an end, which is mostly nothing.
        codes = self._ids(stems.dictionary.to_numpy(zero_copy_only=False).tolist())
        n, codes = len(codes), [*codes, b"", *map(self._end, marks.dictionary.to_pylist())]
        parts = np.full((len(stems), 2), n, np.int64)
        parts[:, 0] = stems.indices.to_numpy()
        parts[where, 1] = marks.indices.to_numpy() + n + 1
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        ids = _taken(np.frombuffer(b"".join(codes), "<u4"), sizes, parts.ravel())
        sizes, which = sizes[parts].sum(1), pieces.indices.to_numpy()
        ids = _taken(ids, sizes, which)
        upto = np.concatenate(([0], np.cumsum(sizes[which])))
        ends = upto[np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)]
        if odd:
            own = np.split(ids, ends)[:-1]
            for i, x in odd.items():
                own[i] = x
            ids, ends = np.concatenate(own), np.cumsum([len(x) for x in own])
        return ids, np.diff(ends, prepend=0)


def _taken(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of values that are lists of these sizes, one after the other, some lists."""
    starts = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int64())
    return pa.LargeListArray.from_arrays(starts, pa.array(values, pa.uint32())).take(pa.array(which)).flatten().to_numpy()


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** SCALE, at least 1 for each symbol that occurs."""
    total, there = int(counts.sum()), counts > 0
    if not total:
        return np.zeros(len(counts), np.int64)
    f = np.where(there, np.maximum(1, counts * (1 << SCALE) // total), 0).astype(np.int64)
    over = int(f.sum()) - (1 << SCALE)
    for i in np.argsort(-f, kind="stable"):  # what rounding leaves is settled by the most frequent
        if not over:
            break
        step = min(over, int(f[i]) - 1) if over > 0 else over
        f[i] -= step
        over -= step
    return f


def lanes_of(n: int) -> int:
    return max(1, min(LANES, n // 256))


def encoded(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    """One block: the coder states, then the words in the order in which decoding takes them."""
    k, shift = lanes_of(len(ids)), np.uint64(32)
    x, words = np.full(k, LOW, np.uint64), []
    f, begin = freq[ids], start[ids]
    limit, rest = f << np.uint64(63 - SCALE), np.uint64(1 << SCALE) - f
    for at in range((len(ids) - 1) // k * k, -1, -k):
        own = slice(at, at + k)
        lane = x[: len(f[own])]
        full = np.flatnonzero(lane >= limit[own])
        high = lane[full]
        words.append(high.astype("<u4"))
        lane[full] = high >> shift
        lane += lane // f[own] * rest[own] + begin[own]
    return x.astype("<u8").tobytes() + (np.concatenate(words[::-1]).tobytes() if words else b"")


def decoded(data: bytes, n: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    k, scale, mask = lanes_of(n), np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    x = np.frombuffer(data, "<u8", k).astype(np.uint64)
    words, used = np.frombuffer(data, "<u4", offset=8 * k).astype(np.uint64), 0
    out = np.empty(n, np.uint32)
    for at in range(0, n, k):
        lane = x[: min(k, n - at)]
        slot = lane & mask
        own = symbol[slot]
        out[at : at + len(lane)] = own
        lane = freq[own] * (lane >> scale) + slot - start[own]
        low = np.flatnonzero(lane < LOW)
        lane[low] = (lane[low] << np.uint64(32)) | words[used : used + len(low)]
        used += len(low)
        x[: len(lane)] = lane
    if used != len(words) or (x != LOW).any():
        raise ValueError("a block does not decode to its end")
    return out


def tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = freq.astype(np.uint64)
    start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    return f, start, np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def write_segment(uri: str, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
    counts = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    for first in range(0, len(ids), BLOCK):  # bincount copies what it counts, in 64 bits
        counts += np.bincount(ids[first : first + BLOCK], minlength=len(counts))
    freq = scaled(counts)
    f, start, _ = tables(freq)
    out, blocks = files.Writer(uri), []
    try:
        out.write(MAGIC)
        for first in range(0, len(ids), BLOCK):
            own = ids[first : first + BLOCK]
            data = encoded(own, f, start)
            blocks.append((first, len(own), out.write(data), len(data), zlib.crc32(data)))
        table = zlib.compress(freq.astype("<u4").tobytes(), 6)
        docs = zlib.compress(json.dumps(doc_ids).encode() + b"\n" + json.dumps(lengths.tolist()).encode(), 1)
        directory = struct.pack("<QQQ", len(blocks), len(table), len(docs)) + b"".join(struct.pack("<QQQQI", *b) for b in blocks) + table + docs
        out.write(directory + struct.pack("<QI", len(directory), zlib.crc32(directory)) + MAGIC)
    finally:
        out.close()


class Segment:
    """A segment file: its directory, and any block on its own."""

    def __init__(self, uri: str):
        self.file = files.Reader(uri)
        size, end = self.file.size(), 12 + len(MAGIC)
        length, crc = struct.unpack("<QI", self.file.read(size - end, 12))
        directory = self.file.read(size - end - length, length)
        if zlib.crc32(directory) != crc or self.file.read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is damaged")
        n, table, docs = struct.unpack_from("<QQQ", directory)
        self.blocks = [struct.unpack_from("<QQQQI", directory, 24 + 36 * i) for i in range(n)]
        rest = directory[24 + 36 * n :]
        self.tables = tables(np.frombuffer(zlib.decompress(rest[:table]), "<u4").astype(np.int64))
        ids, lengths = zlib.decompress(rest[table : table + docs]).split(b"\n")
        self.doc_ids, self.lengths = json.loads(ids), json.loads(lengths)

    def block(self, i: int) -> np.ndarray:
        _, n, at, length, crc = self.blocks[i]
        data = self.file.read(at, length)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        return decoded(data, n, *self.tables)

    def documents(self) -> Iterator[tuple[int, int, int, int]]:
        """doc_id, first id within the segment, number of ids, and their crc32, with one block in memory."""
        i, at, held = -1, 0, np.empty(0, np.uint32)
        first = 0
        for doc_id, n in zip(self.doc_ids, self.lengths, strict=True):
            crc, left = 0, n
            while left:
                if at == len(held):
                    i, at = i + 1, 0
                    held = self.block(i)
                own = held[at : at + left]
                crc, at, left = zlib.crc32(own.astype("<u4").tobytes(), crc), at + len(own), left - len(own)
            yield doc_id, first, n, crc
            first += n
        self.file.close()


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def segments(batches: Iterator[pa.RecordBatch], encoder, folder: str, part: int, segment: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """In a Python worker: writes the segment files of one part, and gives a row of the manifest for each. What Arrow and the
    C library hold without need goes before texts come, and again after TRIM slices and each segment."""
    held, doc_ids, lengths, n, seq, slices = [], [], [], 0, 0, 0

    def close() -> pa.RecordBatch:
        uri = files.fresh(folder, f"tokens-{part:06d}-{seq:06d}")
        sizes, ids = np.concatenate(lengths), np.concatenate(held)
        held.clear()  # else all ids are there twice while they are coded
        write_segment(uri, doc_ids, sizes, ids)
        del ids
        trimmed()
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "path": [uri], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([n], pa.int64())})

    trimmed()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            own = batch.slice(at, SLICE)
            ids, sizes = encoder([x or "" for x in own.column(1).to_pylist()])
            ids, sizes, names = np.insert(ids, np.cumsum(sizes), END), sizes + 1, own.column(0).to_pylist()
            upto = np.concatenate(([0], np.cumsum(sizes)))
            for i in range(0, len(names), 64):
                j = min(i + 64, len(names))
                held.append(ids[upto[i] : upto[j]].copy())  # no view, which would keep the slice's ids
                lengths.append(sizes[i:j])
                doc_ids += names[i:j]
                n += len(held[-1])
                if n >= segment:
                    yield close()
                    held, doc_ids, lengths, n, seq = [], [], [], 0, seq + 1
            slices += 1
            if slices % TRIM == 0:
                trimmed()
    if doc_ids:
        yield close()
    trimmed()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, segment: int = SEGMENT) -> DataFrame:
    """Writes all documents; returns the manifest (part, seq, path, n_docs, n_ids), itself a table in the folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer)
        only("rans", encoder.clear)
        yield from segments(batches, encoder, folder, TaskContext.get().partitionId(), segment)

    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = d.mapInArrow(write, "part long, seq long, path string, n_docs long, n_ids long")
    made.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(made.schema).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the segments that the manifest names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for rows in _chunks(Segment(row["path"]).documents(), 10_000):
                    ids, first, n, crc = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array([row["base"] + x for x in first], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    # One row a segment; their running count over parts, then within parts.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = manifest.withColumn("_inner", inner).join(parts, F.col("part") == F.col("_part")).select("path", (F.col("_before") + F.col("_inner")).alias("base"))
    n = max(manifest.sparkSession.sparkContext.defaultParallelism, manifest.count())
    return m.repartition(min(n, 100_000), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _chunks(rows: Iterator, n: int) -> Iterator[list]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents' token ids and returns what the files hold."""
    return read_tokens(write_tokens(docs, shared_dir(docs.sparkSession, "tokens"), tokenizer))
