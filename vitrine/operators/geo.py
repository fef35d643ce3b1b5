"""Points and areas: spread of groups, points in polygons by grid cells, nearest places, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.scalar import haversine_km


def spread(points: DataFrame, group: str, key: str, lat: str, lon: str) -> DataFrame:
    """(group, n, max_km): the largest distance between two points of a group, over distinct places.

    Places are points on a sphere. The chords between the extremes along each axis bound the largest one from
    below, and a place whose chord to the far corner of its group's box is shorter can't be an end of it; only
    what is left, near the border of the group, is compared in pairs.
    """
    places = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(group, F.col(lat).alias("lat"), F.col(lon).alias("lon")).distinct()
    a, o = F.radians("lat"), F.radians("lon")
    places = places.withColumns({"x": F.cos(a) * F.cos(o), "y": F.cos(a) * F.sin(o), "z": F.sin(a)})
    spot = F.struct("x", "y", "z")
    box = places.groupBy(group).agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))), *(f(spot, F.col(c)).alias(f"{n}{c}") for c in "xyz" for n, f in (("first", F.min_by), ("last", F.max_by))))
    square = lambda p, q: sum((F.pow(p[c] - q[c], 2) for c in "xyz"), F.lit(0.0))
    box = box.select(group, *(f"{n}{c}" for c in "xyz" for n in ("lo", "hi")), F.greatest(*(square(F.col(f"first{c}"), F.col(f"last{c}")) for c in "xyz")).alias("least"))
    corner = sum((F.greatest(F.pow(F.col(c) - F.col(f"lo{c}"), 2), F.pow(F.col(c) - F.col(f"hi{c}"), 2)) for c in "xyz"), F.lit(0.0))
    rim = places.join(box, group).where(corner >= F.col("least") - 1e-12).select(group, "lat", "lon")
    p, q = rim.alias("p"), rim.alias("q")
    far = haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("q.lat"), F.col("q.lon"))
    pairs = p.join(q, F.col(f"p.{group}") == F.col(f"q.{group}")).groupBy(F.col(f"p.{group}").alias(group)).agg(F.max(far).alias("max_km"))
    return points.groupBy(group).agg(F.count_distinct(key).alias("n")).join(pairs, group)


def squares(rows: DataFrame, box: DataFrame, n: int) -> DataFrame:
    """``rows`` (g, k, lat, lon) with ``cy`` and ``cx``, the square of their group's box, which has ``n`` by ``n``."""
    step = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) * n / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-9))), F.lit(n - 1))
    return rows.join(box, "g").select(*rows.columns, step("lat").alias("cy"), step("lon").alias("cx"))


def summed(points: DataFrame, places: DataFrame) -> DataFrame:
    """(g, k, s): for every point (g, k, lat, lon) the distances to the places (g, lat, lon, n) of its group, each n times.
    Tasks add up before anything is shuffled."""
    at = places.select("g", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "n")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return points.join(at, "g").groupBy("g", "k").agg(F.sum(km * F.col("n")).alias("s"))


def outliers(rows: DataFrame, drop: int, grids: tuple[int, ...] = (8, 64, 256)) -> DataFrame:
    """(g, k): the ``drop`` points of each group with the largest sum of distances to its others, ties to the smaller key.

    A square's points stand at their mean; what this changes in a sum is at most the sum of all points' distances to their
    means, the same for every point of the group. So a point whose sum over squares is lower than the ``drop``-th largest
    by more than twice that is none, and few are left to be held against finer squares and at last against all points.
    """
    from vitrine.operators.hierarchy import kept

    box = rows.groupBy("g").agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))))
    ranked = Window.partitionBy("g").orderBy(F.desc("s"), "k")
    left = rows
    for n in grids:
        own = squares(rows, box, n)
        means = own.groupBy("g", "cy", "cx").agg(F.count("*").alias("n"), F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
        error = own.join(means, ["g", "cy", "cx"]).groupBy("g").agg(F.sum(haversine_km(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon"))).alias("e"))
        sums = kept(summed(left, means.select("g", F.col("mlat").alias("lat"), F.col("mlon").alias("lon"), "n")))
        least = sums.withColumn("_i", F.row_number().over(ranked)).where(F.col("_i") <= drop).groupBy("g").agg(F.min("s").alias("least"))
        near = sums.join(least, "g").join(error, "g").where(F.col("s") >= F.col("least") - 2 * F.col("e") - 1e-6).select("g", "k")
        left = kept(left.join(near, ["g", "k"], "left_semi"))
    exact = summed(left, rows.select("g", "lat", "lon", F.lit(1).alias("n"))).withColumn("s", F.round("s", 6))
    return exact.withColumn("_i", F.row_number().over(ranked)).where(F.col("_i") <= drop).select("g", "k")


def trimmed_spread(points: DataFrame, group: str, key: str, lat: str, lon: str, drop: int = 2) -> DataFrame:
    """(group, n, max_km): ``spread`` without the ``drop`` points of each group that lie farthest from its others by the sum
    of their distances (ties: the smaller keys go); groups of at most ``drop`` + 1 points keep all. ``n`` counts the points
    that stay. Keys are distinct within a group; points without a place take no part."""
    rows = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    large = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > drop + 1).select("g")
    gone = outliers(rows.join(large, "g", "left_semi"), drop)
    out = spread(rows.join(gone, ["g", "k"], "left_anti"), "g", "k", "lat", "lon")
    return out.withColumnRenamed("g", group)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a polygon's ring (array of struct(x, y)), by counting crossings."""
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, cell: float = 10.0) -> DataFrame:
    """Points with each polygon that holds them. Polygons are listed under the grid cells of their box, points
    under their own, so the join is on equal cells and the exact test runs on what shares one."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    boxes = polygons.select("*", F.array_min(xs).alias("_x0"), F.array_max(xs).alias("_x1"), F.array_min(ys).alias("_y0"), F.array_max(ys).alias("_y1"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor(F.col(b) / cell).cast("int"))
    listed = boxes.withColumn("_cx", F.explode(span("_x0", "_x1"))).withColumn("_cy", F.explode(span("_y0", "_y1")))
    own = points.withColumn("_cx", F.floor(F.col(x) / cell).cast("int")).withColumn("_cy", F.floor(F.col(y) / cell).cast("int"))
    inside = F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(F.col("_y0"), F.col("_y1")) & in_ring(F.col(x), F.col(y), F.col(ring))
    return own.join(listed, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy", "_x0", "_x1", "_y0", "_y1")


def finest(found: DataFrame, key: str, rank: Column, tie: str) -> DataFrame:
    """The polygon of the finest kind for each point."""
    return found.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(rank, tie))).where("_i = 1").drop("_i")


def nearest(links: DataFrame, places: DataFrame, entity: str, place: str, at: tuple[float, float]) -> DataFrame:
    """(entity, place, km): each entity's place nearest to a point; ties to the smaller place."""
    far = haversine_km(F.lit(at[0]), F.lit(at[1]), F.col("lat"), F.col("lon"))
    return links.join(places, place).groupBy(entity).agg(F.min(F.struct(far.alias("km"), F.col(place).alias("place"))).alias("m")).select(entity, "m.place", "m.km")


def coordinate_faults(lat: Column, lon: Column, box: tuple[float, float, float, float] | None = None) -> Column:
    """The first fault of a coordinate pair: missing, null island, out of range, swapped, outside a box."""
    out = F.lit("ok")
    if box:
        inside = lat.between(box[0], box[1]) & lon.between(box[2], box[3])
        swapped = lon.between(box[0], box[1]) & lat.between(box[2], box[3])
        out = F.when(~inside & swapped, "swapped").when(~inside, "outside").otherwise(out)
    out = F.when((F.abs(lat) > 90) | (F.abs(lon) > 180), "range").otherwise(out)
    return F.when(lat.isNull() | lon.isNull(), "missing").when((lat == 0) & (lon == 0), "null island").otherwise(out)
