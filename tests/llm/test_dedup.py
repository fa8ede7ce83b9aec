"""Lines, repeated bytes and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash

from quillon.llm import components, jaccard, line_dedup, suffixes

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# -- lines


def simhash(line):
    words = [w for w in line.split(" ") if len(w) > line_dedup.SHORT] or line.split(" ")
    counts = [0] * 64
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(words))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def normal(line):
    return re.sub(r"\d+", "0", re.sub(r"[^a-z0-9\n]+", " ", line.lower())).strip()


def test_fuzzy_lines(documents):
    rng = random.Random(1)
    base = [prose(40, rng) for _ in range(12)]
    texts = []
    for i in range(30):
        rows = []
        for _ in range(4):
            words = rng.choice(base).split(" ")
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            rows.append(" ".join(words) if rng.random() < 0.8 else " ".join(words).upper() + "!")
        texts.append("\n".join([*rows, "", "*"]) if i % 5 else None if i == 0 else "\n".join(rows) + " " + prose(300, rng))
    rows = [(d, p, x) for d, t in enumerate(texts) if t for p, x in enumerate(t.split("\n"))]
    forms = sorted({normal(x) for _, _, x in rows} - {""})
    sims = {f: simhash(f) for f in forms}
    links = [(a, b) for i, a in enumerate(forms) for b in forms[:i] if bin(sims[a] ^ sims[b]).count("1") <= 3 and distance(a, b) <= max(len(a), len(b)) * 10 // 100]
    assert len(links) > 20
    group, seen, kept = roots(forms, links), set(), {d: [] for d in range(len(texts))}
    for d, _, x in rows:
        f = normal(x)
        if not f or group[f] not in seen:
            kept[d].append(x)
            if f:
                seen.add(group[f])
    got = {r.doc_id: r for r in line_dedup.deduplicated(documents(texts)).collect()}
    assert {d: r.kept for d, r in got.items()} == {d: "\n".join(x) for d, x in kept.items()}
    assert got[0].n_lines == 0 and sum(r.n_removed for r in got.values()) == len(rows) - sum(map(len, kept.values()))


def typo(word, rng):
    i = rng.randrange(len(word))
    return word[:i] + rng.choice("klmnopq") + word[i + 1 :]


def damaged(words, kind, rng):
    words = list(words)
    if kind == "typo":
        i = rng.randrange(len(words))
        words[i] = typo(words[i], rng)
    elif kind == "word":
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    else:  # typos in different words, as many as an edit similarity of 0.9 allows
        for i in rng.sample(range(len(words)), min(len(words), len(" ".join(words)) // 10)):
            words[i] = typo(words[i], rng)
    return words


def test_recall_of_edit_similarity(documents):
    """Line 2i + 1 is a damaged copy of line 2i; what brute force links has to be found."""
    rng, texts, cases = random.Random(8), [], {}
    for n in (5, 8, 12, 20, 40):
        for kind in ("typo", "word", "most"):
            for _ in range(40):
                words = [rng.choice(VOCABULARY) for _ in range(n)]
                a, b = " ".join(words), " ".join(damaged(words, kind, rng))
                if a != b and distance(a, b) <= max(len(a), len(b)) * 10 // 100:
                    cases.setdefault((n, kind), []).append(len(texts) + 1)
                texts += [a, b]
    gone = {r.doc_id for r in line_dedup.deduplicated(documents(texts), apart=None).where("n_removed > 0").collect()}
    recall = {c: (sum(i in gone for i in ids) / len(ids), len(ids)) for c, ids in cases.items()}
    print(recall)
    assert all(r >= 0.95 for (_, kind), (r, _) in recall.items() if kind != "most"), recall
    assert all(i in {x for ids in cases.values() for x in ids} for i in gone)


def test_lines_are_gone_once_their_groups_are_linked(documents, monkeypatch):
    sizes, put = [], line_dedup.dropped
    monkeypatch.setattr(line_dedup, "dropped", lambda df: (sizes.append("line" in df.columns and "place" in df.columns), put(df)))
    text = "one two three four five six seven eight nine ten"
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicated(documents([text, text + "s\nother", text]), apart=None).collect()}
    assert any(sizes) and got == {0: 0, 1: 1, 2: 1}


def test_lines_of_other_letters_are_no_candidates(documents, monkeypatch):
    formed, put = [], line_dedup.starred

    def counted(*args):
        out = put(*args)
        formed.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "starred", counted)
    one = "alpha beta gamma sand nets trees oats"
    other = "alpha beta gamma tird rett srees oits"  # letters of the same former classes
    texts = [one, other, "quite another line of text stands here alone", "quite another line of text stands here alome"]
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicated(documents(texts), apart=None).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1} and formed == [1]


def test_lines_of_empty_tables_and_copies(documents):
    assert line_dedup.deduplicated(documents([])).count() == 0
    got = line_dedup.deduplicated(documents([(1, "one line here"), (1, "one line here"), (2, "one line here"), (3, "")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 1), (3, 0)]


# -- repeated bytes


def test_repeated_bytes(documents):
    rng = random.Random(2)
    shared = [prose(120, rng) for _ in range(3)]
    texts = [prose(rng.randint(1, 80), rng) + rng.choice(shared)[rng.randint(0, 200) :][: rng.randint(300, 700)] + prose(rng.randint(0, 80), rng) for _ in range(40)]
    texts += [texts[0], texts[0], "é" * 900, "a" * 401, "a" * 400, None, "", "ab" * 300 + "c" + "ab" * 300]
    data = [(t or "").encode() for t in texts]
    count = {}
    for b in data:
        for i in range(len(b) - 399):
            count[b[i : i + 400]] = count.get(b[i : i + 400], 0) + 1
    want = {}
    for d, b in enumerate(data):
        mark = bytearray(len(b))
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                mark[i : i + 400] = b"\x01" * 400
        want[d] = (len(b), sum(mark), len(re.findall(b"\x01+", bytes(mark))), hashlib.sha256(bytes(c for c, m in zip(b, mark, strict=True) if not m)).hexdigest())
    assert sum(w[1] for w in want.values()) > 5000
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(documents(texts)).collect()}
    assert got == want


def test_passages_of_other_documents(documents):
    """Windows of 51 words that another document has, against brute force; those of the same document don't count."""
    rng = random.Random(12)
    shared = [prose(n, rng) for n in (51, 60, 120, 50)]
    texts = [prose(rng.randint(0, 90), rng) + " " + rng.choice(shared) + "  " + prose(rng.randint(0, 60), rng) for _ in range(24)]
    own = prose(70, rng)
    texts += [own + " x " + own, texts[0], texts[0], None, "", " ".join(shared[2].split()[10:95])]
    words = [(t or "").split() for t in texts]
    where = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 50):
            where.setdefault(tuple(w[i : i + 51]), set()).add(d)
    want = {}
    for d, w in enumerate(words):
        mark = bytearray(len(w))
        for i in range(len(w) - 50):
            if len(where[tuple(w[i : i + 51])]) > 1:
                mark[i : i + 51] = b"\x01" * 51
        want[d] = (sum(mark), len(re.findall(b"\x01+", bytes(mark))))
    assert want[24] == (0, 0) and sum(n > 0 for n, _ in want.values()) > 10
    assert {r.doc_id: (r.n_passage_words, r.n_passages) for r in suffixes.without_repeats(documents(texts)).collect()} == want


def test_long_texts_are_scanned_in_pieces(documents, monkeypatch):
    rng = random.Random(3)
    text = "".join(chr(rng.randrange(97, 123)) for _ in range(600_000))
    got = suffixes.without_repeats(documents([text, "x" + text[300_000:301_000]])).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans) for r in got] == [(1000, 1), (1000, 1)]


def test_no_bytes_of_an_empty_table(documents):
    assert suffixes.without_repeats(documents([])).count() == 0


# -- Jaccard join


def test_jaccard_join(documents):
    rng = random.Random(4)
    base = [prose(n, rng) for n in (3, 4, 9, 12, 15, 30, 60, 200)]
    texts = []
    for _ in range(120):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.choice([0, len(words) - 1, rng.randrange(len(words))])] = rng.choice(VOCABULARY)
        texts.append(" ".join(words).title() if rng.random() < 0.3 else "  ".join(words))
    texts += [None, "", " \n", "one", "ONE", "one two"]
    for n, percent in ((4, 85), (5, 80)):
        sets = []
        for t in texts:
            w = (t or "").lower().split()
            sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
        links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        want = {i: (len(sets[i]), r) for i, r in roots(range(len(texts)), links).items()}
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(documents(texts), n, percent).collect()}
        assert got == want
        # Lists of more than two members are refined.
        finer = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.joined(documents(texts), n, percent, crowd=2).collect()}
        assert finer == want
    kept = {r.doc_id for r in jaccard.one_each(documents(texts), 5, 80).collect()}
    assert kept == {r for _, r in want.values()}


def test_keys_are_deleted_before_texts_are_written(documents, monkeypatch):
    steps, put, drop = [], jaccard.written, jaccard.dropped
    monkeypatch.setattr(jaccard, "written", lambda df, purpose: (put(df, purpose), steps.append(purpose))[0])
    monkeypatch.setattr(jaccard, "dropped", lambda df: (steps.append("drop"), drop(df))[0])
    got = jaccard.joined(documents(["a b c d e f", "a b c d e f", "g h i j k", None])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0), (2, 2), (3, 3)]
    assert "drop" in steps[: steps.index("texts")]


def test_large_groups_of_near_copies_form_few_pairs(documents, monkeypatch):
    rng, formed, put = random.Random(9), [], jaccard.across
    base, texts = prose(200, rng).split(), []
    for _ in range(300):
        words = list(base)
        for i in rng.sample(range(len(words)), 2):
            words[i] = rng.choice(VOCABULARY)
        texts.append(" ".join(words))

    def counted(lists, compatible):
        out = put(lists, compatible)
        formed.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "across", counted)
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = roots(range(len(texts)), links)
    assert {r.doc_id: r.component_id for r in jaccard.joined(documents(texts)).collect()} == want
    assert sum(formed) < len(links) / 2, (formed, len(links))


def test_rounds_over_crowded_lists_leave_other_rows_alone(documents, monkeypatch):
    rng, labelled, put = random.Random(10), [], jaccard.labelled
    texts = []
    for copies in [40] + [2] * 60:
        base = prose(100, rng).split()
        for _ in range(copies):
            words = list(base)
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            texts.append(" ".join(words))

    def counted(rows, key, comps):
        if "key" in rows.columns:
            labelled.append(rows.count())
        return put(rows, key, comps)

    monkeypatch.setattr(jaccard, "labelled", counted)
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert {r.doc_id: r.component_id for r in jaccard.joined(documents(texts), centers=2).collect()} == roots(range(len(texts)), links)
    *fewer, most = sorted(labelled)
    assert fewer and max(fewer) < most / 2, labelled


def test_links_of_a_large_group_do_not_meet_in_joins(spark, documents, monkeypatch):
    met, put = [], components._smallest

    def counted(edges):
        met.append(edges.count())
        return put(edges)

    monkeypatch.setattr(components, "_smallest", counted)
    rng = random.Random(12)
    base, texts = prose(100, rng).split(), []
    for _ in range(80):
        words = list(base)
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        texts.append(" ".join(words))
    assert {r.component_id for r in jaccard.joined(documents(texts)).collect()} == {0}
    assert met == []
    # Of more links than a task holds, each task leaves no more than nodes; self links and nulls are none.
    group = [(7 * i, 7 * j) for i in range(60) for j in range(i)]
    links = [*group, *((1000 + i, 1001 + i) for i in range(40)), (-5, 2000), (2000, -9), (3, 3), (None, 4)]
    edges = spark.createDataFrame(links, "u long, v long").repartition(6)
    true = [x for x in links if x[0] is not None and x[0] != x[1]]
    want = roots({x for link in true for x in link}, true)
    for together in (400, 1 << 20):
        met.clear()
        got = components.components(edges, together=together)
        assert got.count() == len(want) and {r.node: r.root for r in got.collect()} == want, together
        assert max(met, default=0) < len(group), met


def test_memory_of_other_operators_goes_before_texts_come(monkeypatch):
    import pyarrow as pa

    steps = []
    monkeypatch.setattr(jaccard, "only", lambda owner: steps.append("only"))
    monkeypatch.setattr(jaccard, "trimmed", lambda: steps.append("trimmed"))

    def batches():
        steps.append("batch")
        yield pa.RecordBatch.from_pydict({"text": ["a b", None]})

    assert [b.num_rows for b in jaccard.sliced(batches(), 0)] == [2]
    assert steps == ["only", "trimmed", "batch", "trimmed"]


def test_jaccard_of_an_empty_table(documents):
    assert jaccard.joined(documents([])).count() == 0


def test_every_boundary_gives_the_same_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    counts = np.ones(1 << jaccard.SKETCH_BITS, np.int64)
    for n in range(1, 60):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for extra in range(0, 12):
            b = np.concatenate([a[extra:], rng.integers(0, 1 << 63, extra, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (2 * n - both):
                continue
            for heavy in (2, 10, 25, 1000):
                assert len(np.intersect1d(jaccard.keys_of(np.unique(a), counts, heavy, 85)[0], jaccard.keys_of(np.unique(b), counts, heavy, 85)[0]))
