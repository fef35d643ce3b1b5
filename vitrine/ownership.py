"""Searches of ownership histories: whole chains of works by conditions on one event, and periods of ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.catalogue import Catalogue, condition, each, party_condition
from vitrine.operators import filters

#: Filters by layer, and what only orders or pages.
SHARED = {"party", "location", "dateFrom", "dateTo", "creator", "objectNumber"}
EVENTS_ONLY = {"transferType", "excludeTransferType", "currency", "hasPrice", "hasGap", "relatedTo", "categoryMethod", "positionMethod"}
PERIODS_ONLY = {"ownerName", "acquisitionMethod", "minDuration", "maxDuration", "periodLocation"}
PAGING = {"sortBy", "sortOrder", "maxResults", "offset"}
SORTS = {"events": {"price", "eventCount", "dateYear"}, "periods": {"duration"}}


def checked(params: dict, layer: str) -> dict:
    """Parameters without nulls. Unknown names, filters of the other layer, sort keys that the layer lacks and
    searches without any filter are errors."""
    p = {k: v for k, v in params.items() if v is not None and v != ""}
    own, other = (EVENTS_ONLY, PERIODS_ONLY) if layer == "events" else (PERIODS_ONLY, EVENTS_ONLY)
    if foreign := set(p) & other:
        raise ValueError(f"{sorted(foreign)} do not go with {layer}")
    if unknown := set(p) - SHARED - own - PAGING:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    if not set(p) - PAGING:
        raise ValueError("a search needs at least one filter")
    if p.get("sortBy") and p["sortBy"] not in SORTS[layer]:
        raise ValueError(f"unknown sort key {p['sortBy']!r}")
    return p


def works(c: Catalogue, p: dict) -> DataFrame:
    """(artwork_id) of the works that the creator's name and the object number leave."""
    out = c.artworks
    if "creator" in p:
        out = out.where(filters.substring(F.col("creator_label"), p["creator"]))
    if "objectNumber" in p:
        out = out.where(filters.glob(F.col("object_number"), p["objectNumber"]))
    return out.select(F.col("art_id").alias("artwork_id"))


def page(found: DataFrame, sort: Column | None, p: dict) -> DataFrame:
    """(artwork_id, sort_value, n_matched) of one page of works, by an aggregate over their matching rows, nulls last."""
    per = found.groupBy("artwork_id").agg((sort if sort is not None else F.lit(None).cast("double")).cast("double").alias("sort_value"), F.count("*").alias("n_matched"))
    order = F.col("sort_value").asc_nulls_last() if p.get("sortOrder") == "asc" else F.col("sort_value").desc_nulls_last()
    return per.orderBy(*([order] if sort is not None else []), "artwork_id").offset(int(p.get("offset", 0))).limit(min(100, int(p.get("maxResults", 25))))


def search_events(c: Catalogue, params: dict) -> DataFrame:
    """Whole chains of a page of works with an event that meets every filter, with ``matched``, ``n_matched`` and
    ``sort_value``. A party and the way its position was found have to stand on one party of that event."""
    p = checked(params, "events")
    tests = {k: p[k] for k in ("transferType", "location", "dateFrom", "dateTo", "currency", "relatedTo", "categoryMethod") if k in p}
    if p.get("hasPrice"):
        tests["hasPrice"] = True
    matched, events = condition(**tests), c.provenance_events
    if "party" in p:
        one = party_condition(p["party"], p.get("positionMethod"))
        named = c.provenance_parties.where(one).select("artwork_id", "sequence").distinct().withColumn("_named", F.lit(True))
        events = events.join(named, ["artwork_id", "sequence"], "left")
        matched = matched & F.col("_named").isNotNull()
    eligible = events
    if {"creator", "objectNumber"} & set(p):
        eligible = eligible.join(works(c, p), "artwork_id", "left_semi")
    if "positionMethod" in p and "party" not in p:
        eligible = eligible.join(c.provenance_parties.where(party_condition(None, p["positionMethod"])).select("artwork_id"), "artwork_id", "left_semi")
    if p.get("hasGap"):
        eligible = eligible.join(c.provenance_events.where("gap").select("artwork_id"), "artwork_id", "left_semi")
    if "excludeTransferType" in p:
        without = c.provenance_events.where(F.col("transfer_type").isin(*each(p["excludeTransferType"]))).select("artwork_id")
        eligible = eligible.join(without, "artwork_id", "left_anti")
    sort = {"price": F.max("price_amount"), "eventCount": F.count("*"), "dateYear": F.min("date_year")}.get(p.get("sortBy"))
    wanted = page(eligible.where(matched), sort, p)
    return events.withColumn("matched", matched).join(F.broadcast(wanted), "artwork_id").drop("_named")  # a page has a hundred works at most


def search_periods(c: Catalogue, params: dict) -> DataFrame:
    """Periods of a page of works with a period that meets every filter, with ``matched``, ``n_matched`` and
    ``sort_value`` (the longest of the matching ones, or the shortest, in years). Open periods have no duration."""
    p, col = checked(params, "periods"), F.col
    matched, years = F.lit(True), col("end_year") - col("begin_year")
    if owner := p.get("ownerName", p.get("party")):
        matched = matched & filters.substring(col("owner_name"), owner)
    if "acquisitionMethod" in p:
        matched = matched & (col("acquisition_method") == p["acquisitionMethod"])
    for name in ("location", "periodLocation"):
        if name in p:
            matched = matched & filters.substring(col("location"), p[name])
    for name, test in (("dateFrom", col("begin_year").__ge__), ("dateTo", col("end_year").__le__), ("minDuration", years.__ge__), ("maxDuration", years.__le__)):
        if name in p:
            matched = matched & test(int(p[name]))
    if p.get("sortBy"):
        matched = matched & (years >= 0)
    matched = F.coalesce(matched, F.lit(False))
    eligible = c.provenance_periods
    if {"creator", "objectNumber"} & set(p):
        eligible = eligible.join(works(c, p), "artwork_id", "left_semi")
    sort = (F.min if p.get("sortOrder") == "asc" else F.max)(years) if p.get("sortBy") else None
    wanted = page(eligible.where(matched), sort, p)
    return c.provenance_periods.withColumn("matched", matched).join(F.broadcast(wanted), "artwork_id")
