"""Decontamination, mixing, quality rules, toxicity and main text."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from quillon.llm import decontaminate, jaccard, mixing, quality, toxicity, wrappers

WORDS = ["alpha", "Beta", "gamma", "été", "of", "x9", "delta", "to", "omega", "pi"]


def prose(n, rng, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))


# -- decontamination


def test_windows_of_benchmark_items(spark, documents):
    rng = random.Random(1)
    many = ["w%d" % i for i in range(300)]
    items = {i: prose(n, rng, many) for i, n in enumerate((40, 25, 10, 12, 4, 1, 30))} | {7: None, 8: "...", 9: ""}
    texts = []
    for _ in range(40):
        own = rng.choice([items[i] for i in (0, 1, 2, 3, 6)]).split(" ")
        at = rng.randrange(len(own))
        texts.append(prose(rng.randint(0, 15), rng, many) + " " + " ".join(own[at : at + rng.randint(5, 30)]).upper() + "-" + prose(rng.randint(0, 15), rng, many))
    texts += [None, "", "!!", items[4], items[2] + " " + items[2]]

    def split(t):
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    want = {}
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for item, it in items.items():
            v = split(it)
            for win in {tuple(v[i : i + 10]) for i in range(len(v) - 9)} if len(v) >= 10 else {tuple(v)} if v else set():
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(str(item))
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    assert sum(w[4] for w in want.values()) > 10
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(documents(texts), bench).collect()}
    assert got == want
    clean = {r.doc_id for r in decontaminate.clean_documents(documents(texts), bench).collect()}
    assert clean == {d for d, w in want.items() if not w[4]}
    assert decontaminate.decontaminate(documents([]), bench).count() == 0
    assert decontaminate.decontaminate(documents(texts), bench.limit(0)).where("contaminated").count() == 0


# -- mixing


def test_mixture(documents):
    rng = random.Random(2)
    rows = [(i, prose(rng.randint(1, 60), rng), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(400)] + [(400, None, "a"), (401, "", "z"), (402, "one two", "y")]
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows if s is not None}) + [None]
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight, target, open_ = {s: k % 3 + 1 for k, s in enumerate(sources)}, {}, set(sources)
    rest = float(sum(total.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * total[s] for s in over}
        rest -= sum(target[s] for s in over)
        open_ -= over
    got = {r.doc_id: r for r in mixing.mix(documents(rows)).collect()}
    assert len(got) == len(rows)
    for i, _, s in rows:
        assert got[i].size == size[i] and got[i].source_size == total[s] and got[i].target == pytest.approx(target[s]) and 0 <= got[i].taken <= 3 * size[i]
    for s in sources:
        assert sum(got[i].taken for i, _, x in rows if x == s) == pytest.approx(target[s], rel=0.02, abs=8)
    assert {r.doc_id: r.taken for r in mixing.mix(documents(rows[::-1])).collect()} == {i: r.taken for i, r in got.items()}
    made = mixing.mixed_documents(documents(rows)).collect()
    words = {}
    for r in made:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: r.taken for i, r in got.items() if r.taken}
    assert mixing.mix(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, None), (2, "")])).collect()] == [0, 0]


def test_small_sources_beside_a_large_one(documents):
    rows = [(i, "w " * 20_000, "hot") for i in range(200)]
    small = {"a": 100, "b": 300, "c": 1000, "d": 7}
    rows += [(1000 + i, "x " * n, s) for i, (s, n) in enumerate(small.items())]
    got = {r.source: r for r in mixing.mix(documents(rows)).where("source <> 'hot'").collect()}
    for s, n in small.items():
        assert got[s].target == 3 * n and got[s].taken == pytest.approx(3 * n, abs=4)


def test_rows_without_a_key_are_mixed_as_rows(documents):
    rows = [(None, "n1 " * 20, "a"), (None, "n2 " * 30, "a"), (5, "five " * 10, "b"), (5, "five " * 10, "b"), (6, "six " * 400, "c")]
    plan = sorted((r.doc_id or 0, r.size, r.taken) for r in mixing.mix(documents(rows)).collect())
    words = {}
    for r in mixing.mixed_documents(documents(rows)).collect():
        w = r.text.split()
        words[w[0]] = words.get(w[0], 0) + len(w)
    assert words["n1"] + words["n2"] == sum(t for i, _, t in plan if not i) > 0
    assert words["five"] == sum(t for i, _, t in plan if i == 5) <= 60 and words["six"] == sum(t for i, _, t in plan if i == 6)


def test_slots_are_spread(documents):
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(60)]
    s = mixing.schedule(mixing.source_targets(mixing.sized(documents(rows)))).orderBy("slot").collect()
    assert [r["rank"] for r in s if r.source == "a"] == list(range(sum(r.source == "a" for r in s)))
    for at in range(0, len(s) - 600, 600):  # every stretch holds each source in about its share
        n = sum(r.source == "c" for r in s[at : at + 600])
        assert abs(n - 300) <= 6


# -- quality


def test_quality_features(documents):
    rng = random.Random(3)
    texts = [prose(rng.randint(0, 50), rng).replace(". ", ".\n") for _ in range(60)] + [None, "", "\n\n", "a b c d e " * 30, "x\nx\n x\nx", "# $ % & | < > *", "le   la", "same five words are here and same five words are here"]
    want = {}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        again = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 5)}
        rows = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(rows) - len(set(rows)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))
    got = {r.doc_id: r for r in quality.quality(documents(texts)).collect()}
    assert {i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for i, r in got.items()} == want
    assert not any(r.kept for r in got.values() if r.base_failed)
    assert quality.quality(documents([])).count() == 0


def test_function_words_count_wherever_they_stand(documents):
    junk = " ".join("x%d" % i for i in range(5000))
    got = {r.doc_id: r for r in quality.quality(documents([junk, junk + " the", junk + " the of the", "the of " + junk, junk[:1000] + " la und " + junk])).collect()}
    assert [(got[i].n_function, got[i].function_words) for i in range(5)] == [(0, -1), (1, 0), (2, 1), (2, 1), (2, 1)]


def test_votes_find_the_bad_half():
    rng = random.Random(4)
    counts = {}
    for _ in range(4000):
        good = rng.random() < 0.6
        vote = tuple(0 if rng.random() < 0.2 else (1 if good == (rng.random() < 0.8) else -1) for _ in range(5))
        counts[vote] = counts.get(vote, 0) + 1
    share, table = quality.fitted(sorted(counts.items()))
    assert share == pytest.approx(0.6, abs=0.05)
    assert quality.posterior((1,) * 5, share, table) > 0.95 > 0.05 > quality.posterior((-1,) * 5, share, table)


# -- toxicity


def test_toxic_pairs_are_learned(spark, documents):
    rng = random.Random(5)
    insults, groups, plain = ["insult%s" % c for c in "abcd"], ["group%s" % c for c in "abcd"], ["w%d" % i for i in range(200)]
    texts, labels = [], []
    for _ in range(1600):
        w = [rng.choice(plain) for _ in range(25)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += [rng.choice(insults)] * a + [rng.choice(groups)] * b
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(a and b))
    rows = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(documents([*texts, None, ""]), rows).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i].predicted, labels[i]) for i in range(1600) if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9  # weights of single words alone reach about 0.75
    assert 0 <= got[1600].score <= 1 and got[1600].score == got[1601].score
    assert toxicity.toxicity(documents([]), rows).count() == 0
    assert {r.score < 0.01 for r in toxicity.toxicity(documents(["a"]), rows.limit(0)).collect()} == {True}


# -- main text


def test_a_fit_empties_the_caches_of_other_operators(monkeypatch):
    import pandas as pd

    from quillon.llm import common

    monkeypatch.setattr(common, "_caches", {})
    for step, rows in ((toxicity._to_terms, {"text": ["a b"], "toxic": [1]}), (toxicity._train, {"terms": [b""], "toxic": [1]})):
        pieces = {"x": b"1"}
        common.only("rans", pieces.clear)
        toxicity._held[1] = object()
        assert len(list(step(iter([pd.DataFrame(rows)])))) == 1
        assert not pieces and not toxicity._held


def test_main_text_of_marked_pages():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a>Menu</a></nav><div class='cookie-notice'>Cookies</div>"
        "<article><h1>Head &amp; line</h1><p>One  <b>bold</b>er&nbsp;word<br>next<p>Two &lt;3<form><input>Send</form><script>var x='</p>'</script><ul><li>a<li>b</ul><div class=comments><p>No</div></article>"
        "<aside>Side</aside><footer>Foot</footer></body></html>"
    )
    assert wrappers.main_text(page) == "Head & line One bolder word next Two <3 a b"
    assert wrappers.main_text("") == "" and wrappers.main_text("<p>cut <b>off") == "cut off" and wrappers.main_text("a < b") == "a < b"


def test_constant_nodes_are_template(spark):
    rng = random.Random(6)
    rows = [(i, f"http://h.example/{i}", f"<body><div>Always the same</div><div id=m>{prose(30, rng)}</div><span>All rights</span>" + ("<i>odd</i>" if i % 3 else "") + "</body>") for i in range(12)]
    rows += [(20, "http://other.example/", "<body><div>Always the same</div></body>"), (21, None, None)]
    got = {r.page_id: r for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert "same" not in got[i].text and "rights" not in got[i].text and got[i].n_chars == len(got[i].text) > 30
    assert got[20].text == "Always the same" and got[21].text == ""
    assert wrappers.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_content_is_found_without_marks(spark, monkeypatch):
    """Nothing is named here: what varies and has most text is the content; without induction all would be kept."""
    rng = random.Random(9)
    texts = [prose(60, rng) for _ in range(10)]
    rows = [(i, f"http://h/{i}", f"<body><div><div>Menu one</div><div class=x{i % 2}>Part {i}</div></div><div><div><p>{t[: len(t) // 2]}</p><b>Read on</b><p>{t[len(t) // 2 :]}</p></div><span>{prose(3, rng)}</span></div></body>") for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: re.sub(r"\s+", " ", t[: len(t) // 2] + " " + t[len(t) // 2 :]).strip() for i, t in enumerate(texts)}
    assert {r.page_id: r.text for r in wrappers.main_texts(pages).collect()} == want
    assert all(wrappers.main_text(h) != want[i] for i, _, h in rows)
    monkeypatch.setattr(wrappers, "BROADCAST_NODES", 0)  # wrappers go to pages by a join
    assert {r.page_id: r.text for r in wrappers.main_texts(pages).collect()} == want


def test_deep_markup(spark):
    deep = "<div>" * 5000 + "end" + "</div>" * 5000
    rows = [(i, "http://d/", deep + str(i)) for i in range(5)]
    got = wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {str(i) for i in range(5)}


def test_simple_tree_matching():
    """Against the recursive definition, on random trees."""
    rng = random.Random(3)

    def tree(depth):
        return rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []

    def text(t, depth=0):
        return [f"{depth} {t[0]}", *(x for c in t[1] for x in text(c, depth + 1))]

    def most(a, b):
        if a[0] != b[0]:
            return 0
        t = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for p, x in enumerate(a[1]):
            for q, y in enumerate(b[1]):
                t[p + 1][q + 1] = max(t[p][q + 1], t[p + 1][q], t[p][q] + most(x, y))
        return 1 + t[-1][-1]

    for _ in range(200):
        a, b = tree(3), tree(3)
        x, y = text(a), text(b)
        got = wrappers.matched("\n".join(x), "\n".join(y))
        assert len(got) == most(a, b)
        assert all(x[i] == y[j] for j, i in got.items()) and sorted(got.values()) == [got[j] for j in sorted(got)]
    assert wrappers.matched("0 r\n1 x\n1 y\n2 z\n1 w", "0 r\n1 y\n2 z\n1 q\n1 w") == {0: 0, 1: 2, 2: 3, 4: 4}


# -- rows and columns of all kinds


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns with names that are used inside, repeated and null doc_ids, null and empty texts."""
    names = ["size", "_id", "_key", "_toxic", "taken", "_copy", "row", "key", "node", "score", "n", "whole", "target"]
    rng = random.Random(4)
    own = [(1, prose(30, rng)), (1, prose(30, rng)), (None, prose(25, rng)), (None, prose(25, rng)), (2, None), (3, ""), (4, prose(40, rng))]
    rows = [(d, t, "en", "s" if i % 2 else None, len(t or ""), *[f"{n}{i}" for n in names]) for i, (d, t) in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(1, 0), (4, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "no such words in here at all, not a single one")], "item_id long, text string")
    assert sorted(map(str, toxicity.civil_documents(docs, labels).collect())) == sorted(map(str, docs.collect()))
    assert sorted(map(str, decontaminate.clean_documents(docs, items).collect())) == sorted(map(str, docs.collect()))
    assert sorted(map(str, jaccard.one_each(docs).collect())) == sorted(map(str, docs.collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert {r["size"] for r in got if r.text and len(r.text) > 0} <= {f"size{i}" for i in range(len(own))}
    assert sum(len(r.text.split()) for r in got) <= 3 * sum(len((t or "").split()) for _, t in own)
    assert max(sum(r["size"] == f"size{i}" for r in got) for i in range(len(own))) <= 3
