"""Exact vector search in column expressions, filters applied before any distance is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def knn(vectors: DataFrame, query: list[float], k: int, key: str, vec: str, eligible: DataFrame | None = None) -> DataFrame:
    """(key, distance): the k nearest by cosine, ties to the smaller key. ``eligible`` (one column of keys)
    restricts the candidates first; None is no restriction, an empty frame leaves none."""
    if eligible is not None:
        vectors = vectors.join(eligible.toDF("_k"), vectors[key] == F.col("_k"), "left_semi")
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.where(F.col(vec).isNotNull()).select(key, (1 - cosine(F.col(vec), q)).alias("distance")).orderBy("distance", key).limit(k)


def similar_items(vectors: DataFrame, item, k: int, key: str, vec: str) -> DataFrame:
    """(key, similarity): the k items nearest to a stored one, itself left out; three decimals."""
    own = F.broadcast(vectors.where(F.col(key) == item).select(F.col(vec).alias("_q")).limit(1))
    scored = vectors.where(F.col(key) != item).crossJoin(own).select(key, cosine(F.col(vec), F.col("_q")).alias("_s"))
    return scored.orderBy(F.desc("_s"), key).limit(k).select(key, F.round("_s", 3).alias("similarity"))


def quantised(vec: Column) -> Column:
    """Signed bytes: components times 127, clipped, truncated toward zero."""
    return F.transform(vec, lambda x: F.least(F.greatest(x.cast("double") * 127, F.lit(-127.0)), F.lit(127.0)).cast("int").cast("tinyint"))


def normalised(vec: Column) -> Column:
    norm = F.sqrt(dot(vec, vec))
    return F.transform(vec, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, i, mean): mean vectors, one row a component (from 0)."""
    return vectors.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def neighbourhood(vectors: DataFrame, query: list[float], key: str, vec: str, seeds: int = 300, each: int = 20) -> DataFrame:
    """(key, distance, n_seeds): the items near any of a query's nearest ``seeds`` items, with their least distance
    to one and how many they are near to. The seeds are a stated, bounded set against all rows; tasks keep the
    nearest few of each seed before anything is shuffled."""
    first = knn(vectors, query, seeds, key, vec).select(F.col(key).alias("_s"))
    own = vectors.join(first, F.col(key) == F.col("_s"), "left_semi").select(F.col(key).alias("_s"), F.col(vec).alias("_q"))
    scored = vectors.where(F.col(vec).isNotNull()).crossJoin(F.broadcast(own)).where(F.col(key) != F.col("_s")).select("_s", key, (1 - cosine(F.col(vec), F.col("_q"))).alias("distance"))
    near = scored.withColumn("_i", F.row_number().over(Window.partitionBy("_s").orderBy("distance", key))).where(F.col("_i") <= each)
    return near.groupBy(key).agg(F.min("distance").alias("distance"), F.count("*").alias("n_seeds"))


def composite_text(parts: list[str], last: list[str] = ()) -> Column:
    """The text to embed: columns in order, arrays joined by commas, empty ones left out; ``last`` go to the end."""
    ordered = [c for c in parts if c not in last] + list(last)
    return F.concat_ws(". ", *(F.nullif(F.trim(F.concat_ws(", ", F.col(c))), F.lit("")) for c in ordered))


def without_frequent(rows: DataFrame, key: str, term: str, most: int) -> DataFrame:
    """(key, terms): each entity's terms that at most ``most`` entities have, in order."""
    common = rows.groupBy(term).agg(F.count_distinct(key).alias("_df")).where(F.col("_df") > most).select(term)
    return rows.join(common, term, "left_anti").groupBy(key).agg(F.array_sort(F.collect_set(term)).alias("terms"))
