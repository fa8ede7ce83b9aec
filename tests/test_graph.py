"""Graph operators against brute force on random and hand-made graphs."""

from __future__ import annotations

import itertools
import random
from collections import deque

import pytest

from quillon.operators import graph


def made(spark, edges, n=None):
    ids = sorted({x for e in edges for x in e} | set(range(n or 0)))
    return spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long")


def random_edges(seed, n=14, m=24):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def reached(edges, start):
    seen, todo = {start}, [start]
    for v in todo:
        for a, b in edges:
            if a == v and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_strong_components(spark, seed):
    edges = random_edges(seed)
    n, e = made(spark, edges, 14)
    far = {i: reached(edges, i) for i in range(14)}
    want = {i: min(j for j in range(14) if j in far[i] and i in far[j]) for i in range(14)}
    assert {r.id: r.component for r in graph.strong_components(n, e).collect()} == want


def test_components_of_a_long_chain(spark):
    n, e = made(spark, [(i, i + 1) for i in range(40)] + [(50, 51)], 0)
    got = {r.id: r.component for r in graph.components(n, e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50}


@pytest.mark.parametrize("seed", range(2))
def test_betweenness(spark, seed):
    edges = [(a, b) for a, b in random_edges(seed, 9, 14) if a != b]
    n, e = made(spark, edges, 9)

    def paths(s, t):
        best, found, todo = None, [], deque([(s,)])
        while todo:
            p = todo.popleft()
            if best and len(p) > best:
                break
            if p[-1] == t:
                best = len(p)
                found.append(p)
                continue
            todo.extend((*p, b) for a, b in edges if a == p[-1] and b not in p)
        return found

    want = {}
    for s, t in itertools.permutations(range(9), 2):
        all_paths = paths(s, t)
        for v in range(9):
            if v not in (s, t) and all_paths:
                want[v] = want.get(v, 0) + sum(v in p for p in all_paths) / len(all_paths)
    want = {v: x / (8 * 7) for v, x in want.items() if x}
    got = {r.id: r.score for r in graph.betweenness(n, e).collect()}
    assert got == pytest.approx(want)


def test_communities_of_two_cliques(spark):
    one, two = list(itertools.combinations(range(5), 2)), list(itertools.combinations(range(5, 10), 2))
    n, e = made(spark, [*one, *two, (0, 5)])
    got = {r.id: r.community for r in graph.communities(n, e).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[1] != got[6]


def test_layers(spark):
    n, e = made(spark, [(3, 2), (2, 1), (3, 1), (4, 5), (5, 4)])
    assert {r.id: r.layer for r in graph.layers(n, e).collect()} == {1: 0, 2: 1, 3: 2}


def test_layers_have_no_bound(spark):
    n, e = made(spark, [(i + 1, i) for i in range(55)])
    assert {r.id: r.layer for r in graph.layers(n, e).collect()} == {i: i for i in range(56)}


def test_pagerank_sums_to_one(spark):
    n, e = made(spark, random_edges(5), 14)
    assert sum(r["rank"] for r in graph.pagerank(n, e).collect()) == pytest.approx(1)


def test_empty_graph(spark):
    n, e = spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long")
    assert graph.pagerank(n, e).count() == graph.components(n, e).count() == graph.strong_components(n, e).count() == 0
