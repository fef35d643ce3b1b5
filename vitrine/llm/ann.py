"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions and ordered along several Hilbert curves, each over directions and a
shifted grid of its own, so that near vectors that one curve parts stay together on another. Each curve is cut
into ranges of equal size, ties broken by a hash, so that very common vectors spread over ranges. A query
looks into the windows around its own place on every curve; what the windows find is merged and scored
again on the original vectors.

The windows' worst kept score is then a bound, and an exact check follows: each range of the first curve has a
ball around its vectors, and the ranges whose ball could hold something better are visited too, so nothing is
missed. On clustered vectors few ranges remain. On vectors without any structure the windows find what they
cover and little more, and most balls stay open: the check is then the queries against all rows, in blocks.
Ranges beyond ``RANGES`` are not made; a range is dealt out in parts of ``PART`` vectors and queries meet a part in
chunks, where it has more than one, so no task holds more than a part and a chunk however large the table is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.shared import cut, stored

CURVES, AXES, BITS, SALT = 4, 4, 8, 20
RANGE, RANGES = 2048, 16_384  # vectors in a range while there are fewer ranges than the most
PART, CHUNK = 32_768, 20_000  # vectors of a range, and queries, that meet in one task
SIDE = 1  # ranges on either side of a query's own that a window takes in


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points on a grid (n, axes), by Skilling's transposition (2004)."""
    x = grid.astype(np.uint64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the larger cells, from the top bit down
        bit, low = np.uint64(q), np.uint64(q - 1)
        for i in range(axes):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << np.uint64(1) | (x[i] >> np.uint64(b) & np.uint64(1))
    return key


def mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order of the components, so equal pairs score alike everywhere."""
    return np.add.accumulate(query * rows, axis=1)[:, -1]


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors that take part, as doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(ok)


def packed(rows: DataFrame, dim: int) -> DataFrame:
    """(id, vec): those of ``dim`` components, as bytes."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.astype("<f8").tobytes() for r in flat], pa.binary())], names=["id", "vec"])

    return rows.where(F.size("v") == dim).mapInArrow(each, "id long, vec binary")


def keyed(rows: DataFrame, dim: int, curves: int) -> DataFrame:
    """``rows`` with each vector's place on every curve (array ``keys``): Hilbert place, then a hash for ties."""
    rng = np.random.default_rng(7)
    axes = rng.standard_normal((curves, dim, AXES))
    shifts = rng.random((curves, AXES))

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("vec"), dim)
            v = v / np.abs(v).max(1, keepdims=True)  # whatever their length: the curves are over directions
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            tie = mixed(batch.column("id").to_numpy()) & np.uint64((1 << SALT) - 1)
            keys = []
            for a, s in zip(axes, shifts, strict=True):  # three deviations of a projected unit vector to either side
                grid = np.clip((v @ a / 12 + 0.25 + s / 2) * (1 << BITS), 0, (1 << BITS) - 1)
                keys.append(hilbert(grid, BITS) << np.uint64(SALT) | tie)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.stack(keys, 1).astype(np.int64).tolist(), pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    return rows.mapInArrow(each, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", keys array<long>")


def ranged(rows: DataFrame, borders: list[list[float]]) -> DataFrame:
    """``rows`` with the range that each key falls into (array ``places``)."""
    cuts = [np.array(b) for b in borders]

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.array(batch.column("keys").to_pylist(), np.float64)
                places = np.stack([np.searchsorted(c, keys[:, i], side="right") for i, c in enumerate(cuts)], 1).astype(np.int32)
                kept = [n for n in batch.schema.names if n != "keys"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(places.tolist(), pa.list_(pa.int32()))], names=[*kept, "places"])

    return rows.mapInArrow(each, ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "keys") + ", places array<int>")


def scored(visits: DataFrame, rows: DataFrame, parts: int, dim: int, k: int) -> DataFrame:
    """(query_id, row, vec_id, score): of every visited range the k nearest, or those that reach the query's bound.

    ``visits``: query_id, qvec, curve, place, bound; ``rows``: row, id, vec, curve, place. Ranges are dealt out in
    ``parts``, and where more than ``CHUNK`` queries visit one, its vectors meet them chunk by chunk.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            queries, own, bounds = matrix(left["qvec"], dim), left["query_id"].to_numpy(), left["bound"].to_numpy()
            v, ids, row = matrix(right["vec"], dim), right["id"].to_numpy(), right["row"].to_numpy()
            # the fast product may differ in its last digits: a margin by lengths now, exact scores and order after
            margin = 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(v, axis=1).max()
            for at in range(0, len(queries), 256):
                near = queries[at : at + 256] @ v.T
                for i, scores in enumerate(near, at):
                    other = ids != own[i]
                    scores[~other] = -np.inf
                    least = bounds[i]
                    if len(scores) > k:
                        least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
                    found = np.flatnonzero(other & (scores >= least - margin[i]))
                    exact = exact_scores(queries[i], v[found])
                    best = np.lexsort((row[found], ids[found], -exact))[:k]
                    best = best[exact[best] >= bounds[i]]
                    for column, values in zip(out, (np.full(len(best), own[i]), row[found][best], ids[found][best], exact[best]), strict=True):
                        column.append(values)
        flat = [np.concatenate(x) if x else np.empty(0) for x in out]
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table({n: pa.array(x.astype(t)) for n, x, t in zip(("query_id", "row", "vec_id", "score"), flat, kinds, strict=True)})

    crowded = visits.groupBy("curve", "place").count().where(F.col("count") > CHUNK).select("curve", "place", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    crowded = F.broadcast(crowded)  # at most a row for each curve and range
    chunks = F.coalesce("chunks", F.lit(1))
    left = visits.join(crowded, ["curve", "place"], "left").withColumn("chunk", F.pmod(F.xxhash64("query_id"), chunks).cast("int")).drop("chunks")
    right = rows.join(crowded, ["curve", "place"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("chunks")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0))
    right = right.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    keys = ["curve", "place", "chunk", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, row long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def balls(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the first curve, their centres and radii: at most ``RANGES`` rows on the driver."""
    member = rows.select(F.col("places")[0].alias("place"), "vec")

    def sums(batches) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            v, place = matrix(batch.column("vec"), dim), batch.column("place").to_numpy()
            for p in np.unique(place).tolist():
                own = v[place == p]
                total[p] = total.get(p, 0) + np.r_[len(own), own.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], names=["place", "s"])

    total: dict[int, np.ndarray] = {}
    flat = member.mapInArrow(sums, "place int, s array<double>").select("place", F.posexplode("s").alias("i", "x")).groupBy("place", "i").agg(F.sum("x").alias("x"))
    for r in flat.collect():
        total.setdefault(r["place"], np.zeros(dim + 1))[r["i"]] = r["x"]
    places = np.array(sorted(total), np.int64)
    centres = np.array([total[p][1:] / total[p][0] for p in places]).reshape(-1, dim)

    def radii(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place = np.searchsorted(places, batch.column("place").to_numpy())
                far = np.linalg.norm(matrix(batch.column("vec"), dim) - centres[place], axis=1)
                most = np.zeros(len(places))
                np.maximum.at(most, place, far)
                have = np.unique(place)
                yield pa.RecordBatch.from_arrays([pa.array(places[have]), pa.array(most[have])], names=["place", "r"])

    far = {r["place"]: r["r"] for r in member.mapInArrow(radii, "place long, r double").groupBy("place").agg(F.max("r").alias("r")).collect()}
    return places, centres, np.array([far[p] for p in places])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, dim: int | None = None, curves: int = CURVES, complete: bool = True, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of ``vectors`` (largest inner product) for every row of ``queries``, itself left out.

    Returns (query_id, rank, vec_id, score), nearest first, ties to the smaller vec_id; all candidates where
    there are fewer than k. Vectors of any length take part, each among those of its own length (of ``dim``
    alone, if given). Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
    do null ids. Candidates with a query's id are left out as its own. Of queries that repeat an id one counts, the
    first by its bytes; candidates that repeat an id, or are equal rows, all count. ``complete=False`` stops
    after the windows. Other columns are not read; empty tables give no rows.
    """
    rows, asked = valid(vectors, id_col, vec_col), valid(queries, id_col, vec_col)
    dims = [dim] if dim is not None else sorted(r["n"] for r in asked.select(F.size("v").alias("n")).distinct().collect())  # one for each length
    found = [nearest(packed(rows, d), packed(asked, d), k, d, curves, complete) for d in dims]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, dim: int, curves: int, complete: bool) -> DataFrame:
    """``search`` over packed vectors (id, vec) of one length."""
    rows = stored(keyed(vectors, dim, curves).withColumn("row", F.monotonically_increasing_id()), "places")
    n = rows.count()
    many = int(min(RANGES, max(1, n // RANGE)))
    parts = max(1, -(-n // (many * PART)))
    share = [(i + 1) / many for i in range(many - 1)]
    names = [f"k{c}" for c in range(curves)]
    spread = rows.select(*(F.col("keys")[c].cast("double").alias(names[c]) for c in range(curves)))
    borders = spread.approxQuantile(names, share, 0.2 / many) if n and share else [[] for _ in names]
    rows = stored(ranged(rows, borders), "ranges")
    asked = ranged(keyed(queries.groupBy("id").agg(F.min("vec").alias("vec")), dim, curves), borders)
    asked = stored(asked, "queries")

    by_curve = rows.select("row", "id", "vec", F.posexplode("places").alias("curve", "place"))
    own = asked.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"), F.posexplode("places").alias("curve", "middle"))
    windows = own.select("query_id", "qvec", "curve", F.explode(F.sequence(F.greatest(F.lit(0), F.col("middle") - SIDE), F.least(F.lit(many - 1), F.col("middle") + SIDE))).alias("place"))
    found = best(scored(windows.withColumn("bound", F.lit(float("-inf"))), by_curve, parts, dim, k).distinct(), k)
    if complete and many > 2 * SIDE + 1:
        found = cut(found)
        full = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        places, centres, radii = balls(rows, dim)
        pending = asked.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"), F.col("places")[0].alias("middle")).join(full, "query_id", "left")
        pending = pending.withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))

        def open_ranges(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q, bound, middle = matrix(batch.column("qvec"), dim), batch.column("bound").to_numpy(), batch.column("middle").to_numpy()
                size = np.linalg.norm(q, axis=1)[:, None]
                reach = q @ centres.T + size * (radii + 1e-12 * (np.linalg.norm(centres, axis=1) + radii))
                could = (reach >= bound[:, None]) & (np.abs(places - middle[:, None]) > SIDE)
                i, j = np.nonzero(could)
                ids, raw = batch.column("query_id").to_numpy(), batch.column("qvec").to_pylist()
                for s in range(0, len(i), 8192):
                    a, b = i[s : s + 8192], j[s : s + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array([raw[x] for x in a], pa.binary()), pa.array(np.zeros(len(a), np.int32)), pa.array(places[b].astype(np.int32)), pa.array(bound[a])], names=["query_id", "qvec", "curve", "place", "bound"])

        visits = pending.select("query_id", "qvec", "middle", "bound").mapInArrow(open_ranges, "query_id long, qvec binary, curve int, place int, bound double")
        rest = scored(visits, by_curve.where("curve = 0"), parts, dim, k)
        found = best(found.select("query_id", "row", "vec_id", "score").unionByName(rest).distinct(), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
