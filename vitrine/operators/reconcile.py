"""Matching of names and places against authorities: exact, by fallback, by likeness, and what is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.scalar import jaccard, normalised

#: How much likeness of names, types, hierarchy and distance count in a candidate's score.
WEIGHTS = {"name": 40.0, "type": 25.0, "parent": 20.0, "distance": 15.0}


def by_name(rows: DataFrame, authority: DataFrame, key: str, name: str, other_key: str, other_name: str) -> DataFrame:
    """(key, match, n_matches, verdict): rows whose trimmed, lower-case name one authority entry has are accepted,
    those that several have go to review (with the smallest), the rest is unmatched."""
    fold = lambda c: F.lower(F.trim(F.col(c)))
    found = authority.where(fold(other_name) != "").groupBy(fold(other_name).alias("_n")).agg(F.count_distinct(other_key).alias("n_matches"), F.min(other_key).alias("match"))
    out = rows.join(found, fold(name) == F.col("_n"), "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    verdict = F.when(F.col("n_matches") == 1, "accepted").when(F.col("n_matches") > 1, "review").otherwise("unmatched")
    return out.select(key, "match", "n_matches", verdict.alias("verdict"))


def with_fallback(rows: DataFrame, exact: DataFrame, labels: DataFrame, key: str, code: str, label: str) -> DataFrame:
    """(key, match, matched_by): by code (``exact``: code, id), else by a label that one entry alone has
    (``labels``: label, id)."""
    alone = labels.groupBy(F.lower("label").alias("_l")).agg(F.count_distinct("id").alias("_c"), F.min("id").alias("_by_label")).where("_c = 1")
    codes = exact.groupBy(F.col("code").alias("_code")).agg(F.min("id").alias("_by_code"))
    out = rows.join(codes, F.col(code) == F.col("_code"), "left").join(alone, F.lower(F.col(label)) == F.col("_l"), "left")
    how = F.when(F.col("_by_code").isNotNull(), "code").when(F.col("_by_label").isNotNull(), "label")
    return out.select(key, F.coalesce("_by_code", "_by_label").alias("match"), how.alias("matched_by"))


def alike(a: DataFrame, b: DataFrame, key: str, name: str, least: float = 0.5) -> DataFrame:
    """(a, b, similarity): pairs of names with a token likeness (Jaccard) of at least ``least``.

    Names meet under the rarest of their tokens that any such pair has to share: of n tokens the
    ``n - ceil(least * n) + 1`` rarest, so frequent tokens join few rows and no pair is missed.
    """
    def tokens(df: DataFrame, side: str) -> DataFrame:
        words = F.array_distinct(F.array_remove(F.split(normalised(F.col(name)), " "), ""))
        return df.select(F.col(key).alias(side), words.alias(f"w{side}")).where(F.size(f"w{side}") > 0)

    left, right = tokens(a, "a"), tokens(b, "b")
    both = left.select(F.explode("wa").alias("t")).union(right.select(F.explode("wb").alias("t"))).groupBy("t").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame, side: str) -> DataFrame:
        each = df.select(side, F.size(f"w{side}").alias("n"), F.explode(f"w{side}").alias("t")).join(both, "t")
        order = F.row_number().over(Window.partitionBy(side).orderBy("df", "t"))
        return each.withColumn("i", order).where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(side, "t")

    met = prefix(left, "a").join(prefix(right, "b"), "t").select("a", "b").distinct()
    out = met.join(left, "a").join(right, "b").withColumn("similarity", jaccard(F.col("wa"), F.col("wb")))
    return out.where(F.col("similarity") >= least).select("a", "b", "similarity")


def candidate_score(name: Column, same_type: Column, same_parent: Column, km: Column, reach_km: float = 100.0) -> Column:
    """0 to 100: likeness of names (0 to 1), same type, same parent, and nearness that ends at ``reach_km``."""
    near = F.greatest(F.lit(0.0), 1 - F.coalesce(km, F.lit(reach_km)) / reach_km)
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    return F.round(WEIGHTS["name"] * F.coalesce(name, F.lit(0.0)) + WEIGHTS["type"] * flag(same_type) + WEIGHTS["parent"] * flag(same_parent) + WEIGHTS["distance"] * near, 2)


def preferred(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of the first source in order that has a key, with ``source``."""
    ranked = None
    for rank, (name, rows) in enumerate(sources.items()):
        part = rows.withColumns({"source": F.lit(name), "_rank": F.lit(rank)})
        ranked = part if ranked is None else ranked.unionByName(part)
    first = Window.partitionBy(key).orderBy("_rank")
    return ranked.withColumn("_i", F.row_number().over(first)).where("_i = 1").drop("_i", "_rank")


def suffix_join(rows: DataFrame, others: DataFrame, uri: str, other_uri: str) -> DataFrame:
    """Rows with the others whose URI ends in the same local id, by an equal derived key."""
    local = lambda c: F.nullif(F.substring_index(F.col(c), "/", -1), F.lit(""))
    return rows.withColumn("_l", local(uri)).join(others.withColumn("_r", local(other_uri)), F.col("_l") == F.col("_r")).drop("_l", "_r")


def suspicious_repeats(places: DataFrame, label: str, lat: str, lon: str, least: int = 5, words: int = 3) -> DataFrame:
    """(lat, lon, n, first_words): coordinates that many places share whose names begin differently."""
    first = F.lower(F.split_part(F.trim(F.col(label)), F.lit(" "), F.lit(1)))
    out = places.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.count("*").alias("n"), F.count_distinct(first).alias("first_words"))
    return out.where((F.col("n") >= least) & (F.col("first_words") >= words))


def far_from_parent(tree: DataFrame, key: str, parent: str, lat: str, lon: str, km: float = 500.0) -> DataFrame:
    """(n, far, share) of children with coordinates that stand farther from their parent than ``km``."""
    from vitrine.functions.scalar import haversine_km

    up = tree.select(F.col(key).alias("_k"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    both = tree.join(up, F.col(parent) == F.col("_k")).where(F.col(lat).isNotNull() & F.col("_lat").isNotNull())
    far = haversine_km(F.col(lat), F.col(lon), F.col("_lat"), F.col("_lon")) > km
    return both.agg(F.count("*").alias("n"), F.count_if(far).alias("far")).withColumn("share", F.when(F.col("n") > 0, F.round(F.col("far") / F.col("n"), 4)))


def clusters(vectors: DataFrame, vec: str, k: int, seed: int = 42) -> DataFrame:
    """Vectors with the ``cluster`` that k-means puts them in."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vec).isNotNull()).withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=seed).fit(rows)
    return model.transform(rows).drop("_v")
