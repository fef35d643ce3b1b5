"""Records of one entity: pairing, crosswalks, names, rooms, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_records(rows: DataFrame, entities: DataFrame, order: list[Column], key: str = "art_id") -> DataFrame:
    """Rows of some entities in order, with ``place`` (from 1) and ``total`` of their entity."""
    w = Window.partitionBy(key)
    own = rows.join(entities.select(key), key, "left_semi")
    return own.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w)).orderBy(key, "place")


def paired_roles(creators: DataFrame, roles: DataFrame, pairs: DataFrame, key: str = "art_id") -> DataFrame:
    """(key, creator_id, role_id): each creator with the role that a pair row gives; without pair rows creators
    and roles go together by place if there are as many of both; else the role stays null.

    ``creators`` and ``roles``: key, place, creator_id or role_id; ``pairs``: key, creator_id, role_id, part_index.
    """
    w = Window.partitionBy(key, "creator_id").orderBy("part_index")
    first = pairs.withColumn("_i", F.row_number().over(w)).where("_i = 1").select(key, "creator_id", F.col("role_id").alias("_paired"))
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    out = creators.join(first, [key, "creator_id"], "left").join(pairs.select(key).distinct().withColumn("_has", F.lit(True)), key, "left")
    out = out.join(count(creators, "_nc"), key).join(count(roles, "_nr"), key, "left").join(roles.select(key, "place", F.col("role_id").alias("_by_place")), [key, "place"], "left")
    zipped = F.when(F.col("_has").isNull() & (F.col("_nc") == F.col("_nr")), F.col("_by_place"))
    return out.select(key, "creator_id", F.coalesce("_paired", zipped).alias("role_id"))


def source_text(parts: dict[str, str]) -> Column:
    """'[Label] value [Label] value', empty columns left out; ``parts``: label by column."""
    return F.concat_ws(" ", *(F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.concat(F.lit(f"[{label}] "), F.trim(F.col(c)))) for c, label in parts.items()))


def room_hash(location: Column, prefix: str = "HG-") -> Column:
    """What identifies a room in a location code: without its prefix, up to the next dash."""
    return F.split_part(F.when(location.startswith(prefix), F.substr(location, F.lit(len(prefix) + 1))).otherwise(location), F.lit("-"), F.lit(1))


def crosswalk(ids: DataFrame, key: str, ranks: dict[str, int]) -> DataFrame:
    """(key, equivalents): ids at the authorities in ``ranks``, in their order; other authorities stay hidden."""
    rank = F.try_element_at(F.create_map(*(F.lit(x) for p in ranks.items() for x in p)), F.col("authority"))
    own = ids.withColumn("rank", rank).where("rank is not null")
    return own.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("rank", "authority", "id", "uri"))).alias("equivalents"))


def other_names(names: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, variants): distinct names in order, without the label itself. ``names``: key, name; ``labels``: key, label."""
    return names.join(labels, key).where(F.col("name") != F.col("label")).groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("variants"))


def split_ids(ids: DataFrame, key: str) -> DataFrame:
    """(key, handle, others): the handle, null if there is none, and the other external ids."""
    handle = F.col("authority") == "handle"
    return ids.groupBy(key).agg(F.min(F.when(handle, F.col("uri"))).alias("handle"), F.array_sort(F.collect_set(F.when(~handle, F.struct("authority", "id")))).alias("others"))


def mark_counts(evidence: DataFrame, key: str, signature: str, inscription: str) -> DataFrame:
    """(key, signatures, inscriptions, total) of attribution evidence."""
    kind = F.col("evidence_type_aat")
    return evidence.groupBy(key).agg(F.count_if(kind == signature).alias("signatures"), F.count_if(kind == inscription).alias("inscriptions"), F.count("*").alias("total"))


def importance(artworks: DataFrame, mappings: DataFrame, set_field: int) -> DataFrame:
    """(art_id, importance): 3 for an image, 3 for a narrative, up to 100 for edges, up to 20 for sets."""
    counts = mappings.groupBy(F.col("artwork_id").alias("art_id")).agg(F.count("*").alias("_n"), F.count_if(F.col("field_id") == set_field).alias("_s"))
    flags = F.when(F.col("has_image") == 1, 3).otherwise(0) + F.when(F.coalesce(F.col("narrative_text"), F.lit("")) != "", 3).otherwise(0)
    score = flags + F.least(F.coalesce("_n", F.lit(0)), F.lit(100)) + F.least(F.coalesce("_s", F.lit(0)), F.lit(20))
    return artworks.join(counts, "art_id", "left").select("art_id", score.cast("long").alias("importance"))


def category(members: Column, label: Column, top_share: Column, keywords: list[str]) -> Column:
    """What kind of set it is: an umbrella, an album, of one type, a subject by its name, else a part of a collection."""
    named = F.lit(False)
    for k in keywords:
        named = named | F.contains(F.lower(label), F.lit(k.lower()))
    return F.when(members >= 500_000, "umbrella").when(F.lower(label).startswith("album "), "album").when(top_share >= 0.95, "object_type").when(named, "iconographic").otherwise("sub_collection")


def period_rollup(periods: DataFrame, key: str) -> DataFrame:
    """(key, n, first_year, last_year, longest, any_uncertain) of periods; open or negative ones have no duration."""
    years = F.col("end_year") - F.col("begin_year")
    return periods.groupBy(key).agg(F.count("*").alias("n"), F.min("begin_year").alias("first_year"), F.max("end_year").alias("last_year"), F.max(F.when(years >= 0, years)).alias("longest"), F.bool_or("uncertain").alias("any_uncertain"))
