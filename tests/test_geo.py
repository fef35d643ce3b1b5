"""The trimmed spread of groups against all pairs, and a large group."""

import math
import random

from vitrine.operators import geo


def km(p, q):
    a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def brute(points, drop):
    if len(points) > drop + 1:
        far = sorted(points, key=lambda k: (-round(sum(km(points[k], q) for q in points.values()), 6), k))[:drop]
        points = {k: p for k, p in points.items() if k not in far}
    return len(points), max(km(p, q) for p in points.values() for q in points.values())


def test_against_all_pairs(spark):
    rng = random.Random(4)
    groups = {g: {k: (rng.gauss(50, 3), rng.gauss(g * 20 - 80, 4)) for k in range(rng.choice([1, 2, 3, 4, 60]))} for g in range(8)}
    groups[1] |= {1000: (-40.0, 170.0), 1001: (51.0, -120.0)}
    groups[9] = {k: (10.0, 10.0) for k in range(5)}
    rows = [(g, k, *p) for g, points in groups.items() for k, p in points.items()] + [(0, 5000, None, 1.0), (77, 1, None, None)]
    df = spark.createDataFrame(rows, "g int, id int, lat double, lon double")
    for drop in (1, 2):
        found = {r["g"]: (r["n"], r["max_km"]) for r in geo.trimmed_spread(df, "g", "id", "lat", "lon", drop).collect()}
        wanted = {g: brute(p, drop) for g, p in groups.items()}
        assert found.keys() == wanted.keys()
        assert all(found[g][0] == wanted[g][0] and abs(found[g][1] - wanted[g][1]) < 1e-3 for g in wanted)
    assert geo.trimmed_spread(df.limit(0), "g", "id", "lat", "lon").count() == 0


def test_a_large_group(spark):
    df = spark.range(100_000).selectExpr("1 as g", "id", "45 + 5 * sin(id * 0.37) * cos(id * 0.11) as lat", "5 + 5 * cos(id * 0.23) * sin(id * 0.07) as lon")
    far = spark.createDataFrame([(1, -1, -45.0, 150.0), (1, -2, -46.0, 151.0)], "g int, id long, lat double, lon double")
    row = geo.trimmed_spread(df.union(far), "g", "id", "lat", "lon").first()
    assert row["n"] == 100_000 and 1000 < row["max_km"] < 2000
