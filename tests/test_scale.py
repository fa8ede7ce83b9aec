"""Operators on cases where sums, ties and crowded keys go wrong."""

from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from quillon.operators import coupling, evaluation, graph, lines, retrieval, spans, symbols, telemetry


def test_running_share_reaches_its_limit(spark):
    e = spark.createDataFrame([(1, i, i, 0.1) for i in range(10)], "session long, us long, event_id long, value double")  # ten tenths add up to less than 1
    assert [r.state for r in telemetry.running_share(e, 1.0).orderBy("event_id").collect()] == ["ok"] * 7 + ["warn", "warn", "over"]


def span_cases(spark, seed=0, n=60):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), rng.choice(["f", "p.f", "q.f", "g", "p.g", ""]), s := rng.randrange(40), s + rng.choice([0, 1, 5, 30, 300])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, file string, name string, start_line int, end_line int")


def test_tightest_spans_against_all_pairs(spark):
    rows, s = span_cases(spark)
    points = [(f, line) for f in "abc" for line in range(0, 350, 7)]
    want = {(f, x): min((e - b, i) for i, g, _, b, e in rows if g == f and b <= x <= e)[1] for f, x in points if any(g == f and b <= x <= e for _, g, _, b, e in rows)}
    got = symbols.at_line(s, spark.createDataFrame(points, "file string, line int"))
    assert {(r.file, r.line): r.id for r in got.collect()} == want
    keyed = coupling.tightest(spark.createDataFrame([(f"{f}{x}", f, x) for f, x in points], "key string, file string, line int"), s)
    assert {(r.file, r.line): r.id for r in keyed.collect()} == want


def test_enclosing_and_touched_spans_against_all_pairs(spark):
    rows, s = span_cases(spark, 1)
    want = {i: min((d - c, j) for j, g, _, c, d in rows if g == f and c <= b and e <= d and j % 3)[1] for i, f, _, b, e in rows if any(g == f and c <= b and e <= d and j % 3 for j, g, _, c, d in rows)}
    assert {r.id: r.chunk for r in symbols.linked(s, s.where("id % 3 > 0")).collect()} == want
    some = rows[:5]
    got = spans.touched(s.selectExpr("file", "start_line AS low", "end_line AS high"), s.where("id < 5"))
    assert {tuple(r) for r in got.collect()} == {(f, b, e) for _, f, _, b, e in rows if any(g == f and b <= d and c <= e for _, g, _, c, d in some)}


def test_matched_names_against_all_pairs(spark):
    rows, s = span_cases(spark, 2)
    bare = lambda x: x.rsplit(".", 1)[-1]
    got = symbols.matched(s.selectExpr("file", "id AS a", "name AS x"), s.selectExpr("file", "id AS b", "name AS y"), "file").collect()
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and (a[2] == b[2] or a[2] == bare(b[2]) or bare(a[2]) == b[2]))
    assert sorted((r.a, r.b) for r in got) == want


def test_joins_of_spans_make_few_rows(spark):
    """A thousand spans of one file: no join compares all of them with all of a thousand others."""
    s = spark.range(1000).selectExpr("id", "'f' AS file", "concat('n', id) AS name", "CAST(id AS INT) AS start_line", "CAST(id + 900 AS INT) AS end_line")
    made = (
        symbols.linked(s, s), symbols.matched(s.selectExpr("file", "id AS a", "name AS x"), s.selectExpr("file", "id AS b", "name AS y"), "file"),
        symbols.at_line(s, s.selectExpr("file", "start_line AS line")), coupling.tightest(s.selectExpr("name AS key", "file", "start_line AS line"), s),
    )
    for df in made:
        assert df.count() == 1000
        assert most_rows(df) < 300_000


def most_rows(df):
    """The most rows that a join of df makes."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
            if "Join" in kind:
                most = max(most, p.metrics().apply("numOutputRows").value())
    return most


def test_metrics_by_label_make_no_pairs(spark):
    v = spark.range(600).selectExpr("id", "CASE WHEN id = 7 THEN NULL WHEN id = 8 THEN 99 ELSE CAST(id % 2 AS INT) END AS label")
    q = v.where("id % 20 = 0 OR id IN (7, 8)").selectExpr("id AS qid", "label")
    ranked = q.selectExpr("qid", "explode(array(1, 2, 3)) AS rank").selectExpr("qid", "(qid + rank * rank) % 600 AS id", "rank")
    gold = q.join(v, "label").where("qid <> id")
    got = evaluation.label_metrics(ranked, q, v)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, evaluation.metrics(ranked, gold).collect()))
    assert most_rows(got) <= 600


def test_containing_makes_a_row_for_each_block(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(400))
    d = spark.createDataFrame([(i, text[i:] + "\n" + text[:300]) for i in range(40)], "id long, content string")
    q = spark.createDataFrame([(1, text[500:620]), (2, text[30:70]), (3, text[5:12]), (4, "\n" + text[:38]), (5, text[-39:]), (6, "x" * 50), (7, None), (8, "")], "qid long, text string")
    got = evaluation.containing(q, d)
    want = {(b.qid, a.id) for a in d.collect() for b in q.collect() if b.text and b.text in a.content}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


@pytest.mark.parametrize("few", [True, False])
def test_bm25_in_blocks_against_all_pairs(spark, monkeypatch, few):
    for name, n in (("CHUNK_BLOCK", 7), ("TERM_BLOCK", 2), ("BROADCAST_BLOCKS", 64 if few else 1)):
        monkeypatch.setattr(retrieval, name, n)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    c = [(i, " ".join(rng.choices(words, k=rng.randrange(9))), f"p/{rng.choice(words)}", rng.choice(["window", "section"])) for i in range(60)]
    c += [(100 + i, *c[5][1:]) for i in range(9)]  # equal scores
    asked = {q: set(rng.sample([*words, "absent"], 4)) for q in range(7)}
    asked[9] = asked[2]
    tf = {i: Counter({w: t.split().count(w) + 2 * (w == p[2:]) for w in words}) for i, t, p, _ in c}
    size = {i: len(t.split()) + 3 for i, t, _, _ in c}
    mean, df = sum(size.values()) / len(c), {w: sum(tf[i][w] > 0 for i in tf) for w in words}
    idf = {w: max(math.log((len(c) - n + 0.5) / (n + 0.5)), 1e-6) if n < len(c) / 2 else 1e-6 for w, n in df.items()}
    want = {}
    for q, terms in asked.items():
        s = [(round(x, 9), -i) for i, _, _, kind in c if (x := sum(idf[w] * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for w in terms if w in idf) * (0.7 if kind == "window" else 1.0)) > 0]
        want |= {(q, rank): (-i, x) for rank, (x, i) in enumerate(sorted(s, reverse=True)[:5], 1)}
    chunks = spark.createDataFrame(c, "id long, content string, path string, kind string").repartition(3)
    terms = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "qid long, term string")
    got = retrieval.bm25(chunks, terms, 5)
    assert {(r.qid, r["rank"]): (r.id, round(r.score, 9)) for r in got.collect()} == want
    assert most_rows(got) < 400


def test_blocks_go_to_workers_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BATCH_BYTES", 1000)
    v = spark.range(4).selectExpr("id", "array(CAST(1 AS FLOAT), CAST(id AS FLOAT)) AS embedding")
    assert retrieval.knn(v, v.withColumnRenamed("id", "qid"), 2).count() == 8
    rows = spark.range(40, numPartitions=1).selectExpr("repeat('x', 900) AS x").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert max(r.n for r in rows.collect()) <= 2


def test_hops_do_not_make_the_edges_anew(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    e = spark.range(12).selectExpr("id AS src", "id + 1 AS dst").mapInArrow(counted, "src long, dst long")
    got = graph.reach(e, spark.range(1).withColumnRenamed("id", "seed"), 6)
    assert {r.id: r.depth for r in got.collect()} == {i: i for i in range(1, 7)}
    assert made.value == 12


def test_nearest_in_time_makes_no_pairs(spark):
    rng = random.Random(4)
    a, b = ([(rng.choice(["x", "y", None]), i, rng.randrange(-50, 400)) for i in range(150)] for _ in range(2))
    want = {(i, min((abs(u - v), v, j) for k2, j, v in b if k2 == k and abs(u - v) <= 9)[::2]) for k, i, u in a if k and any(k2 == k and abs(u - v) <= 9 for k2, _, v in b)}
    left, right = (spark.createDataFrame(x, "key string, id long, us long") for x in (a, b))
    got = coupling.nearest(left, right, 9)
    assert {(r.left_id, (r.gap, r.right_id)) for r in got.collect()} == want and len(want) > 50
    busy = spark.range(600).selectExpr("'x' AS key", "id", "id AS us")
    assert most_rows(coupling.nearest(busy, busy, 1000)) <= 600


def test_counts_of_a_text_shuffle_nothing(spark):
    d = spark.createDataFrame([(1, "one two three\none two three\n one two\tthree one two three"), (2, "x"), (3, None), (4, "aaaa\nab")], "id long, content string")
    for df in (lines.ngram_codebook(d), lines.cross_entropy(d)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert lines.ngram_codebook(d).collect() == lines.ngram_codebook(lines.lines(d)).collect()
    assert sorted(lines.cross_entropy(d).collect()) == sorted(lines.cross_entropy(lines.lines(d)).collect())
    assert {r.id: round(r.bits, 3) for r in lines.cross_entropy(d).collect()}[4] == 0.0


def test_strong_components_broadcast_nothing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "settled", lambda df, f=graph.settled: plans.append(df) or f(df))
    e = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)] + [(7, 8), (8, 7), (4, 7), (8, 9)], "src long, dst long")
    got = graph.strong_components(spark.range(10), e)
    assert {r.id: r.component for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9}
    assert all("Broadcast" not in df._jdf.queryExecution().executedPlan().toString() for df in [*plans, got])


@pytest.mark.parametrize("made", [graph.components, graph.communities, graph.betweenness])
def test_components_broadcast_nothing(spark, monkeypatch, made):
    plans = []
    monkeypatch.setattr(graph, "settled", lambda df, f=graph.settled: plans.append(df) or f(df))
    got = made(spark.range(6), spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "src long, dst long"))
    assert got.count() > 0 and all("Broadcast" not in df._jdf.queryExecution().executedPlan().toString() for df in [*plans, got])


def test_products_of_vectors_are_small(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PRODUCT_ROWS", 3)
    v = spark.range(20, numPartitions=1).selectExpr("id", "array(CAST(cos(id) AS FLOAT), CAST(sin(id) AS FLOAT)) AS embedding")
    got = {(r.qid, r.id) for r in retrieval.knn(v, v.withColumnRenamed("id", "qid"), 2).collect()}
    want = {(q, i) for q in range(20) for i in sorted((j for j in range(20) if j != q), key=lambda j: -math.cos(q - j))[:2]}
    assert got == want
