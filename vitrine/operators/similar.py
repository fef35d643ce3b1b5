"""Similarity channels of one seed entity, and their pooling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.aggregates import document_frequency


def idf_overlap(edges: DataFrame, seed, entity: str, term: str, weight: Column | None = None, least_terms: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """(entity, score, n_shared): sum of ln(N / df), times a weight, over terms shared with the seed. Terms in
    ``exclude`` don't count; a seed with fewer than ``least_terms`` terms has no result."""
    pairs = edges.select(F.col(entity).alias("entity"), F.col(term).alias("term")).where("entity is not null and term is not null").distinct()
    if exclude is not None:
        pairs = pairs.join(exclude.toDF("term"), "term", "left_anti")
    own = pairs.where(F.col("entity") == seed).select("term")
    if least_terms > 1:
        own = own.join(F.broadcast(own.agg(F.count("*").alias("_n")).where(F.col("_n") >= least_terms)))
    idf = document_frequency(pairs, "term", "entity").join(own.select("term"), "term", "left_semi").select("term", "idf")
    gain = F.col("idf") * (weight if weight is not None else F.lit(1.0))
    return pairs.where(F.col("entity") != seed).join(idf, "term").groupBy("entity").agg(F.sum(gain).alias("score"), F.count("*").alias("n_shared"))


def pair_overlap(pairs: DataFrame, seed, entity: str, qualifier: str, creator: str, strength: dict[str, float]) -> DataFrame:
    """(entity, score): sum of strength(qualifier) * ln(N / df of the creator) over shared (qualifier, creator)."""
    rows = pairs.select(F.col(entity).alias("entity"), F.col(qualifier).alias("q"), F.col(creator).alias("c")).distinct()
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in strength.items() for x in p)), F.col("q")), F.lit(0.0))
    idf = document_frequency(rows, "c", "entity").select(F.col("term").alias("c"), "idf")
    own = rows.where(F.col("entity") == seed).select("q", "c").join(idf, "c")
    return rows.where(F.col("entity") != seed).join(own, ["q", "c"]).groupBy("entity").agg(F.round(F.sum(weight * F.col("idf")), 2).alias("score"))


def edge_tiers(edges: DataFrame, seed, source: str, peer: str, label: str, tiers: dict[str, float], other: float) -> DataFrame:
    """(entity, score, labels): the largest tier weight of the edges between the seed and each peer."""
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in tiers.items() for x in p)), F.col(label)), F.lit(other))
    own = edges.where((F.col(source) == seed) & F.col(peer).isNotNull() & (F.col(peer) != seed))
    return own.groupBy(F.col(peer).alias("entity")).agg(F.max(weight).alias("score"), F.array_sort(F.collect_set(label)).alias("labels"))


def pooled(channels: dict[str, DataFrame], least: int = 4) -> DataFrame:
    """(entity, n_channels, channels, best): entities found by at least ``least`` channels (entity, score), with
    their best raw score; most channels first to read, then the smaller entity."""
    rows = reduce(DataFrame.unionByName, [c.select("entity", F.col("score").cast("double").alias("score"), F.lit(name).alias("channel")) for name, c in channels.items()])
    found = rows.groupBy("entity").agg(F.count_distinct("channel").alias("n_channels"), F.array_sort(F.collect_set("channel")).alias("channels"), F.max("score").alias("best"))
    return found.where(F.col("n_channels") >= least)


def notation_overlap(edges: DataFrame, seed, entity: str, notation: str, least_depth: int = 5) -> DataFrame:
    """(entity, score, n_shared): as ``idf_overlap``, each notation weighted by its length; an entity that shares
    one notation shorter than ``least_depth`` only is left out. One decimal."""
    deep = F.max(F.length("term"))
    pairs = edges.select(F.col(entity).alias("entity"), F.col(notation).alias("term")).distinct()
    idf = document_frequency(pairs, "term", "entity").select("term", "idf")
    own = pairs.where(F.col("entity") == seed).select("term").join(idf, "term")
    shared = pairs.where(F.col("entity") != seed).join(own, "term").groupBy("entity")
    found = shared.agg(F.round(F.sum(F.length("term") * F.col("idf")), 1).alias("score"), F.count("*").alias("n_shared"), deep.alias("_deep"))
    return found.where((F.col("n_shared") > 1) | (F.col("_deep") >= least_depth)).drop("_deep")
