import math

import numpy as np
import pytest

from vitrine.llm import ann

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, asked, k):
    """query: [(vec_id, score)], largest inner product first, ties to the smaller id."""
    ok = {i: np.array(v, float) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in asked:
        if q in ok:
            scores = [(-float(np.add.accumulate(ok[q] * v)[-1]), i) for i, v in ok.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def answered(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 60), dim))
    v = centres[rng.integers(0, len(centres), n)] + 0.3 * rng.standard_normal((n, dim))
    v[: n // 10] = v[0]  # a very common vector
    return [(i, [float(x) for x in row], 0) for i, row in enumerate(v)]


@pytest.mark.parametrize(("n", "dim"), [(700, 8), (1500, 64)])
def test_every_neighbour_is_found(spark, monkeypatch, n, dim):
    monkeypatch.setattr(ann, "RANGE", 64)
    monkeypatch.setattr(ann, "CHUNK", 20)
    rows = clustered(n, dim, n)
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = answered(ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20, dim).collect())
    assert found == brute(rows, range(0, n, 20), 20)


def test_windows_alone_reach_most(spark, monkeypatch):
    monkeypatch.setattr(ann, "RANGE", 128)
    rows = clustered(2000, 16, 5)
    vectors = spark.createDataFrame(rows, SCHEMA)
    found = answered(ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20, 16, complete=False).collect())
    want = brute(rows, range(0, 2000, 20), 20)
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])
    assert recall >= 0.9


def test_lengths_repeats_and_scales(spark, monkeypatch):
    """Vectors of three lengths, equal rows, and lengths from a millionth to a million; parts and chunks as small as can be."""
    for name, value in (("RANGE", 64), ("PART", 16), ("CHUNK", 5)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(3)
    rows = []
    for dim in (3, 8, 32):
        for i in range(300):
            scale = 10.0 ** rng.integers(-6, 7)
            rows.append((len(rows), [float(x) for x in rng.standard_normal(dim) * scale], 0))
    rows += [rows[7], rows[7], rows[401]]  # equal rows
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = answered(ann.search(vectors, vectors.where("vec_id % 20 = 0"), 10).collect())
    for q in range(0, 900, 20):
        own = np.array(rows[q][1])
        scores = sorted((-float(np.add.accumulate(own * np.array(v))[-1]), i) for i, v, _ in rows if i != q and len(v) == len(own))
        assert found[q] == [(i, -s) for s, i in scores[:10]]


def test_odd_vectors_and_empty_tables(spark):
    from pyspark.sql import functions as F

    v = [1.0, 2.0]
    rows = [(0, v, 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [3.0], 0), (None, v, 0), (7, v, 0), (8, v, 0), (9, [-1.0, 0.0], 0), (20, [0.5, 0.5], 0)]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "vec": F.lit("y"), "keys": F.lit("z"), "places": F.lit("p")})
    found = answered(ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20, 2).collect())
    assert found == {0: [(7, 5.0), (8, 5.0), (20, 1.5), (9, -1.0)], 20: [(0, 1.5), (7, 1.5), (8, 1.5), (9, -0.5)]}
    assert ann.search(vectors.limit(0), vectors.limit(0), 20, 2).count() == 0
    assert ann.search(vectors, vectors.limit(0), 20, 2).count() == 0


def test_hilbert_neighbours_touch():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3), -1).reshape(-1, 3)
    order = np.argsort(ann.hilbert(grid, 3))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()
