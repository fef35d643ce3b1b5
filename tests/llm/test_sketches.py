"""Sketches of shingle sets: what they bound, and that long lists of sets that differ give no pairs to verify."""

import random

import numpy as np

from vitrine.llm import simhash


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(1)
    for many in (1, 30, 900, 9000):
        pool = r.integers(0, 1 << 63, 2 * many, np.uint64)
        x, y = (np.unique(r.choice(pool, many)) for _ in "xy")
        apart = np.bitwise_count(simhash.sketch(x).view(np.uint64) ^ simhash.sketch(y).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(x, y))
        assert not (simhash.sketch(x) ^ simhash.sketch(x)).any()


def test_a_long_list_of_different_texts_is_not_verified_pair_by_pair(spark, monkeypatch):
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(1 << 40)}" for _ in range(n)]
    shared, tails = words(25), [words(22) for _ in range(45)]
    texts = [shared + t for t in tails] + [[*shared, *tails[0][:-1], "other"]]
    texts += [sum((tails[(m + 9 * i) % 45] for i in range(5)), []) + words(150) for m in range(540)]
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    pairs = []

    def told(found, *rest, verified=simhash.verified):
        pairs.append(found.count())
        return verified(found, *rest)

    monkeypatch.setattr(simhash, "verified", told)
    groups = {x["doc_id"]: x["component_id"] for x in simhash.similar(docs).collect()}
    assert groups == {n: 0 if n == 45 else n for n in range(len(texts))}
    assert sum(pairs[1:]) < 50, pairs
