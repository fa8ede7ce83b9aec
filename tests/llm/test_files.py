"""Token files, web archives and the pipeline: round trips and brute force."""

from __future__ import annotations

import hashlib
import importlib.util
import random
import zlib

import numpy as np
import pytest

from quillon.llm import rans, warc
from quillon.llm.common import shared_dir

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
ODD = ["", "a  b c\n\nd ", " x\ty<|endoftext|> it's ok\n", "don't, stop!\nÉté 12ab", "\n", " ", "\x01\x02", "a b　c", "word." * 50, "ünï—çø 日本語 text", "A\n B", "\nlead"]


def test_pieces_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(TOKENIZER), rans.Encoder(TOKENIZER)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é.,'\n 1x!") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    ids, n = own(texts)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_segments_ids_are_in_memory_once_and_free_memory_goes_back(tmp_path, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    kept, given = [], []

    def write_segment(uri, doc_ids, lengths, ids):
        kept.append(tracemalloc.get_traced_memory()[0] / ids.nbytes)

    def encode(texts):
        return np.full(10_000 * len(texts), 7, np.uint32), np.full(len(texts), 10_000)

    monkeypatch.setattr(rans, "write_segment", write_segment)
    monkeypatch.setattr(rans, "trimmed", lambda: given.append(len(kept)))
    batches = (pa.RecordBatch.from_pydict({"doc_id": list(range(64)), "text": ["x"] * 64}) for _ in range(8))
    tracemalloc.start()
    try:
        rows = [r for b in rans.segments(batches, encode, f"file://{tmp_path}", 0, 2_000_000) for r in b.to_pylist()]
    finally:
        tracemalloc.stop()
    assert [r["n_docs"] for r in rows] == [256, 256] and sum(r["n_ids"] for r in rows) == 512 * 10_001
    assert max(kept) < 1.8  # with the last slice's; the ids of the segment, and again what they were joined from, would be over 2
    assert given[0] == 0 and len(given) >= 4  # before texts, between slices, after a segment


def test_pieces_kept_are_bounded_and_frequent_ones_are_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(rans, "CACHE_PIECES", 50)
    t, own, encoded = Tokenizer.from_file(TOKENIZER), rans.Encoder(TOKENIZER), []
    whole = own._whole
    monkeypatch.setattr(own, "_whole", lambda text: encoded.append(text) or whole(text))
    for i in range(100):
        texts = [f"often this\nword{i} x{i}, <|endoftext|> l'été", "", "often  uneven"]
        ids, n = own(texts)
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(own.codes) <= 50 and len(own.former) <= 50
    assert sum("often this" in x or " this" in x for x in encoded) == 1
    assert [len(x) for x in own([""])] == [0, 1] and [len(x) for x in own([])] == [0, 0]


def test_words_before_marks_are_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    t, own, encoded = Tokenizer.from_file(TOKENIZER), rans.Encoder(TOKENIZER), []
    whole = own._whole
    monkeypatch.setattr(own, "_whole", lambda text: encoded.append(text) or whole(text))
    rng = random.Random(4)
    texts = ["x quagnop, quagnop. quagnop!\nand quagnop?!", "", "<|endoftext|>, l'été, 12. a.b. '; é!"]
    texts += ["".join(rng.choice("aZ9 é.,;:!?%&*#$'\n日|>") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    ids, n = own(texts)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert "".join(encoded).count("quagnop") == 1


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 255, 256, 5000, 70_000):
        ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
        freq, start, symbol = rans.tables(rans.scaled(np.bincount(ids)))
        data = rans.encoded(ids, freq, start)
        assert (rans.decoded(data, n, freq, start, symbol) == ids).all()
    assert rans.scaled(np.array([1, 0, 10**9, 3])).sum() == 1 << rans.SCALE


def test_token_files(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(3)
    rows = [(i * 7 % 101, rng.choice(ODD) + " text" * rng.randint(0, 30)) for i in range(101)] + [(500, None), (501, ""), (502, "long " * 3000)]
    manifest = rans.write_tokens(documents(rows), shared_dir(spark, "t"), TOKENIZER, segment=500)
    assert manifest.count() > 1
    got = [tuple(r) for r in rans.read_tokens(manifest).orderBy("doc_id").collect()]
    at, want = 0, []
    for d, x in sorted(rows):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert rans.tokenised(documents([]), TOKENIZER).count() == 0
    segment = rans.Segment(manifest.first().path)
    assert len(segment.block(0)) == segment.blocks[0][1]  # any block decodes alone


def test_archives(spark):
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(i, f"http://h{i % 5}.example.com/p{i}?q", big if i % 4 == 0 else f"<p>{i}</p>" * 200 if i % 4 == 1 else "small") for i in range(40)] + [(100, None, None), (101, "http://h1.example.com/p1?q", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_dir(spark, "w")
    lines = warc.write_archives(pages, folder)
    directory = warc.write_index(lines, folder)
    got = {r.page_id: r for r in warc.read_archives(directory, lines.select("key")).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        last = max(j for j, _, h in rows if (h or "") == (html or "")) if len(data) >= 1000 else i
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if last == i else ("revisit", last))
    some = warc.read_archives(directory, spark.createDataFrame([(warc.url_key("http://h2.example.com/p2?q"),), ("none",)], "key string"))
    assert [r.page_id for r in some.collect()] == [2]
    index = warc.Index.of(directory)
    assert [p for p, _ in index.captures("http://h1.example.com/p1?q")] == [1, 101]
    assert index.captures("http://H1.example.com/p1?q")[0][1] == rows[1][2].encode() and index.captures("http://none.example/") == []
    assert warc.archived(spark.createDataFrame([], pages.schema)).count() == 0


def test_lookups_across_blocks_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"http://h{i % 3}.example.com/p{i % 7}", f"text {i}") for i in range(100)] + [(None, "http://h1.example.com/p1", "null"), (3, "http://h1.example.com/p1", "again")]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_digest) for r in got) == sorted((-1 if i is None else i, hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows)


def test_keys():
    assert warc.url_key("http://www.Example.org:80/A?b") == "org,example,www:80)/A?b"
    assert warc.url_key("https://a.b") == "b,a)/" and warc.url_key(None) == ""


@pytest.mark.skipif(not importlib.util.find_spec("corpus_pipeline"), reason="the pipeline is not here")
def test_pipeline_stages(spark):
    import corpus_pipeline
    from quillon.llm import decontaminate, jaccard
    from quillon.llm.common import table, written

    sf_dir = "/root/testdata/sf0.001"
    docs, kept = table(spark, sf_dir, "documents"), []
    assert [f(spark, docs.limit(0), sf_dir).count() for _, f in corpus_pipeline.STAGES] == [0] * 5
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        kept.append(docs)
    assert all(k.columns == ["doc_id", "text", "lang", "source", "n_chars"] for k in kept[:-1])
    assert jaccard.joined(kept[1], 5, 80).where("doc_id <> component_id").count() == 0
    assert decontaminate.decontaminate(kept[2], table(spark, sf_dir, "benchmark")).where("contaminated").count() == 0
    assert kept[4].count() == kept[3].count() > 0
