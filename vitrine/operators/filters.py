"""Predicates and semi-joins that select entities. Each takes and gives DataFrames, by column names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import text as T
from vitrine.functions.scalar import glob_pattern, haversine_km


def linked_to_all(entities: DataFrame, edges: DataFrame, key: str, edge_key: str, edge_term: str, terms: Iterable[Sequence]) -> DataFrame:
    """Entities with an edge to each group of terms (a group is any of its terms): one semi-join a group.
    A group without terms leaves no entity."""
    for group in terms:
        hit = edges.where(F.col(edge_term).isin(list(group)) if group else F.lit(False)).select(F.col(edge_key).alias("_k"))
        entities = entities.join(hit, entities[key] == F.col("_k"), "left_semi")
    return entities


def linked_by_any(entities: DataFrame, key: str, sources: Iterable[DataFrame]) -> DataFrame:
    """Entities whose key is in the only column of any source: one semi-join with their union."""
    ids = None
    for s in sources:
        s = s.toDF("_k")
        ids = s if ids is None else ids.union(s)
    return entities.join(ids.distinct(), entities[key] == F.col("_k"), "left_semi")


def word(column: Column, value: str) -> Column:
    """Whole word, any case; word borders are Unicode."""
    return column.rlike(rf"(?iuU)\b{_quoted(value)}\b")


def substring(column: Column, value: str) -> Column:
    """Contains, any case; % and _ stand for themselves."""
    return F.contains(F.lower(column), F.lit(value.lower()))


def _quoted(value: str) -> str:
    import re

    return re.escape(value)


def tiered_label(labels: DataFrame, label: str, phrase: str, skipped: frozenset[str] = frozenset()) -> DataFrame:
    """Labels matched by the first tier that matches any: the phrase; forms of its words in any order, but for the
    ``skipped`` ones; the phrase without spaces as a substring. Adds ``tier``."""
    pad = T.padded(T.tokens(F.col(label)))
    words = F.lit(True)
    groups = T.expanded(" ".join(w for w in T.words_of(phrase) if w not in skipped))
    for group in groups or []:
        some = F.lit(False)
        for w in group:
            some = some | T.has_phrase(pad, w)
        words = words & some
    words = words if groups else F.lit(False)
    plain = F.contains(F.replace(F.lower(F.col(label)), F.lit(" "), F.lit("")), F.lit(phrase.lower().replace(" ", "")))
    tagged = labels.withColumn("tier", F.when(T.has_phrase(pad, phrase), 1).when(words, 2).when(plain, 3)).where("tier is not null")
    return tagged.join(F.broadcast(tagged.agg(F.min("tier").alias("tier"))), "tier")


def same_row(entities: DataFrame, rows: DataFrame, key: str, row_key: str, condition: Column, negate: bool = False) -> DataFrame:
    """Entities with (or without) a row on which the whole condition holds."""
    hit = rows.where(condition).select(F.col(row_key).alias("_k"))
    return entities.join(hit, entities[key] == F.col("_k"), "left_anti" if negate else "left_semi")


def interval(earliest: Column, latest: Column, low: int, high: int, how: str = "overlaps") -> Column:
    """Intervals that overlap [low, high], lie within it, or have their midpoint in it."""
    if how == "overlaps":
        return (earliest <= high) & (latest >= low)
    if how == "within":
        return (earliest >= low) & (latest <= high)
    if how == "midpoint":
        return (earliest + latest).between(2 * low, 2 * high)
    raise ValueError(f"unknown interval predicate {how!r}")


def glob(column: Column, pattern: str) -> Column:
    return column.rlike(glob_pattern(pattern)) if set(pattern) & set("*?") else column == pattern


def measured(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """A measure in a range; zero is unknown and in no range with an upper bound."""
    out = column.isNotNull()
    if low is not None:
        out = out & (column >= low)
    if high is not None:
        out = out & (column <= high) & (column > 0)
    return out


def presence(entities: DataFrame, others: DataFrame, key: str, other_key: str, present: bool | None) -> DataFrame:
    """Entities with (True) or without (False) a row elsewhere; None: all."""
    if present is None:
        return entities
    return same_row(entities, others, key, other_key, F.lit(True), negate=not present)


def near_point(places: DataFrame, lat: str, lon: str, at: tuple[float, float], km: float) -> DataFrame:
    """Places within a radius (0.1 to 500 km), with ``km``: a box that reaches the scan, then the distance."""
    import math

    km = min(500.0, max(0.1, km))
    up = km / 111.0
    across = km / (111.0 * max(0.01, math.cos(math.radians(at[0]))))
    box = F.col(lat).between(at[0] - up, at[0] + up) & F.col(lon).between(at[1] - across, at[1] + across)
    far = haversine_km(F.lit(at[0]), F.lit(at[1]), F.col(lat), F.col(lon))
    return places.where(box).withColumn("km", far).where(F.col("km") <= km)
