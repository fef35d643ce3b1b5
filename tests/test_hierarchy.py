"""Interval labels of trees against walks over the same edges."""

import random
from collections import defaultdict, deque

from vitrine.operators import hierarchy


def walked(edges, roots, depth):
    under = defaultdict(set)
    for node, up in edges:
        if node is not None and up is not None and node != up:
            under[up].add(node)
    seen, todo = {}, deque((r, 0) for r in roots)
    while todo:
        node, d = todo.popleft()
        if node in seen or d > depth:
            continue
        seen[node] = d
        todo.extend((c, d + 1) for c in under[node])
    return seen


def labels_of(spark, edges):
    return hierarchy.labelled(spark.createDataFrame(edges, "id long, up long"), "id", "up")


def found(spark, edges, roots, depth=10, made=None):
    labels, others = made or labels_of(spark, edges)
    got = hierarchy.below(labels, others, spark.createDataFrame([(r,) for r in roots], "r long"), depth)
    rows = [(r["id"], r["depth"]) for r in got.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows), labels, others


def test_ranges_hold_what_stands_below(spark):
    edges = [(1, None), (2, 1), (3, 1), (4, 2), (5, 2), (6, None), (7, 6), (4, 2), (None, 1), (8, 8), (9, 77)]
    got, labels, others = found(spark, edges, [1])
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2} and others.count() == 0
    rows = {r["id"]: r for r in labels.collect()}
    assert sorted(r["lo"] for r in rows.values()) == list(range(1, len(rows) + 1))
    for r in rows.values():
        assert {x["id"] for x in rows.values() if r["lo"] <= x["lo"] <= r["hi"]} == {x["id"] for x in rows.values() if r["id"] in x["path"]}


def test_several_parents_cycles_and_nested_roots(spark):
    r = random.Random(1)
    edges = [(n, r.randrange(n)) for n in range(1, 60)] + [(r.randrange(60), r.randrange(60)) for _ in range(12)] + [(100, 102), (101, 100), (102, 101), (103, 101), (110, 111), (111, 110), (0, None)]
    made = labels_of(spark, edges)
    for roots, depth in (([0], 3), ([5, 7, 101], 10), ([103, 110, 0, 1], 10), ([12345], 10)):
        want = walked(edges, [x for x in roots if x != 12345], depth)
        assert found(spark, edges, roots, depth, made)[0] == want


def test_empty_trees_and_long_chains(spark):
    assert found(spark, [], [1])[0] == {}
    got, labels, _ = found(spark, [(n, n - 1) for n in range(1, 300)] + [(0, None)], [5], 400)
    assert got == {n: n - 5 for n in range(5, 300)} and labels.count() == 300


def test_many_roots_take_a_join(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BOUND", 1)
    edges = [(n, n // 3) for n in range(1, 90)] + [(0, None), (80, 4)]
    assert found(spark, edges, [3, 4, 11])[0] == walked(edges, [3, 4, 11], 10)


def test_a_catalogue_with_stored_labels_finds_the_same_places(spark):
    from vitrine.catalogue import Catalogue

    places = [(f"p{n}", n, f"p{n // 3}" if n else None) for n in range(40)]
    vocabulary = spark.createDataFrame(places, "id string, vocab_int_id long, broader_id string")
    labels, others = hierarchy.labelled(vocabulary, "id", "broader_id")
    terms = spark.createDataFrame([(2,), (5,)], "vocab_rowid long")
    found = lambda **more: sorted(r[0] for r in Catalogue(vocabulary=vocabulary, **more).with_narrower(terms).collect())
    assert found(broader_labels=labels, broader_others=others) == found() != []


def test_many_ranges_don_t_overflow_the_planner(spark):
    """Two to ``BOUND`` roots were a chain of as many conditions, too deep for the stack of a driver."""
    edges = [(0, None), *((n, 0) for n in range(1, 451)), *((n + 1000, n) for n in range(1, 451))]
    assert found(spark, edges, [*range(1, 451)])[0] == {n: d for d in (0, 1) for n in range(1000 * d + 1, 1000 * d + 451)}


def test_cycles_are_cut_without_paths(spark):
    up = lambda edges: spark.createDataFrame(edges, "id long, up long")
    tails = [(10 * n, 10 * n - 10) for n in range(2, 40)] + [(9, 10), (8, 9), (10, 8), (50_000, 10)]
    assert sorted(r["id"] for r in hierarchy.cuts(up([*tails, (1, 2), (2, 1), (7, None), (6, 7)])).collect()) == [1, 8]
    assert hierarchy.cuts(up([(2, 1), (1, None)])) is None
