"""A catalogue of entities, a controlled vocabulary and typed edges between them, and what is asked of it.

``Catalogue`` holds DataFrames by name (``artworks``, ``vocabulary``, ``mappings``, ``field_lookup`` and more where
there are some) and composes the operators. Every method gives a DataFrame; nothing runs before it is read.
Store ``mappings`` partitioned by ``field_id``: every vocabulary filter then reads its own partitions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.functions import text as T
from vitrine.operators import aggregates, details, filters, hierarchy, similar, text, vector

#: Vocabulary filters, the edge fields that each looks at, and the type of its terms.
VOCABULARY_FILTERS = {
    "subject": (("subject",), None), "iconclass": (("subject",), None), "depictedPerson": (("subject",), "person"), "depictedPlace": (("subject", "spatial"), "place"),
    "productionPlace": (("production_place", "spatial"), "place"), "material": (("material",), None), "technique": (("technique",), None), "type": (("type",), None),
    "creator": (("creator",), None), "collectionSet": (("collection_set",), "set"), "theme": (("theme",), None), "sourceType": (("source_type",), None),
    "productionRole": (("production_role",), None), "attributionQualifier": (("attribution_qualifier",), None), "aboutActor": (("subject", "creator"), "person"),
    "profession": (("profession",), None), "birthPlace": (("birth_place",), "place"), "deathPlace": (("death_place",), "place"),
}
#: Text filters and their columns, sort keys and their columns, presence filters and their tables.
TEXTS = {"title": "title_all_text", "description": "description_text", "inscription": "inscription_text", "curatorialNarrative": "narrative_text"}
SORTS = {"height": "height_cm", "width": "width_cm", "dateEarliest": "date_earliest", "dateLatest": "date_latest", "recordModified": "record_modified"}
PRESENCE = {"hasProvenance": "provenance_events", "hasExhibitions": "artwork_exhibitions", "hasExternalIds": "artwork_external_ids", "hasExaminations": "examinations", "hasModifications": "modifications", "hasParent": "artwork_parent"}
FILLED = {"hasInscription": "inscription_text", "hasNarrative": "narrative_text"}
EVENTS = {"transferType": "transferType", "provenanceLocation": "location", "provenanceDateFrom": "dateFrom", "provenanceDateTo": "dateTo", "categoryMethod": "categoryMethod", "parseMethod": "parseMethod", "unsold": "unsold", "uncertain": "uncertain", "gap": "gap", "crossRef": "crossRef"}
PARTIES = {"party": "party", "positionMethod": "positionMethod", "partyRole": "partyRole"}
LINKED = {"gender", "placeType", "exhibition", "hasAltNames", "hasWikidataCreator"}
#: Words of personal names that say nothing when the words are looked for one by one.
NAME_PARTICLES = frozenset("van von de di du of zu het the la le el den der ten ter della".split())
OTHER = {"creationDate", "dateMatch", "minHeight", "maxHeight", "minWidth", "maxWidth", "objectNumber", "imageAvailable", "expandPlaceHierarchy", "sameRowMatching", "textQuery", "hasDimensions", "nearPlace", "nearLat", "nearLon", "nearPlaceRadius"}
PAGING = {"sortBy", "sortOrder", "maxResults", "offset"}
#: Filters that only narrow others.
MODIFIERS = {"imageAvailable", "expandPlaceHierarchy", "sameRowMatching", "dateMatch", "nearPlaceRadius"}


def cleaned(params: dict) -> dict:
    """Parameters without nulls and blanks, strings trimmed, 'true' and 'false' as booleans. Unknown names and
    queries without a filter are errors."""
    out = {}
    for k, v in params.items():
        v = v.strip() if isinstance(v, str) else v
        if v is None or v in ("", "null") or v == []:
            continue
        out[k] = {"true": True, "false": False}.get(v, v) if isinstance(v, str) else v
    if unknown := set(out) - {*VOCABULARY_FILTERS, *TEXTS, *PRESENCE, *FILLED, *EVENTS, *PARTIES, *LINKED, *OTHER, *PAGING}:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    if not set(out) - MODIFIERS - PAGING:
        raise ValueError("a query needs at least one filter")
    return out


def each(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


class Catalogue:
    """Tables by name, and queries over them."""

    def __init__(self, **tables: DataFrame):
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(f"the catalogue has no table {name!r}") from None

    def edges(self, *fields: str) -> DataFrame:
        """(artwork_id, vocab_rowid) of the edges in the named fields."""
        ids = self.field_lookup.where(F.col("name").isin(*fields)).select(F.col("id").alias("field_id"))
        # a field of the edges that is a constant leaves no key to join by; without the hint the edges may be broadcast
        return self.mappings.join(F.broadcast(ids), "field_id", "left_semi").select("artwork_id", "vocab_rowid").distinct()

    def terms(self, name: str, value) -> DataFrame:
        """(vocab_rowid) of the terms that a filter's value means: an iconclass is a notation, anything else the first
        tier of label matches that has any; a creator's id, as ``persons`` gives it, comes before labels."""
        kind = VOCABULARY_FILTERS[name][1]
        terms = self.vocabulary.where(F.col("type") == kind) if kind else self.vocabulary
        if name == "iconclass":
            return terms.where(F.col("notation") == str(value)).select(F.col("vocab_int_id").alias("vocab_rowid"))
        labels = terms.select("vocab_int_id", F.explode(F.array("label_en", "label_nl")).alias("label")).where("label <> ''")
        if name in ("creator", "aboutActor", "depictedPerson") and "person_names" in self.tables:
            names = self.person_names.join(terms.select(F.col("id").alias("person_id"), "vocab_int_id"), "person_id")
            labels = labels.unionByName(names.select("vocab_int_id", F.col("name").alias("label")))
        if name == "creator" and "entity_alt_names" in self.tables:
            bodies = self.entity_alt_names.where("entity_type in ('organisation', 'group')")
            names = bodies.join(terms.select(F.col("id").alias("entity_id"), "vocab_int_id"), "entity_id")
            labels = labels.unionByName(names.select("vocab_int_id", F.col("name").alias("label")))
        people = name in ("creator", "aboutActor", "depictedPerson")
        found = filters.tiered_label(labels, "label", str(value), NAME_PARTICLES if people else frozenset()).select("vocab_int_id", "tier")
        if name == "creator" and str(value).isdigit():
            found = found.unionByName(terms.where(F.col("id") == str(value)).select("vocab_int_id", F.lit(0).alias("tier")))
            found = found.join(F.broadcast(found.agg(F.min("tier").alias("tier"))), "tier")
        return found.select(F.col("vocab_int_id").alias("vocab_rowid")).distinct()

    def with_narrower(self, terms: DataFrame) -> DataFrame:
        """Terms and all that stand below them: by the labels that ``hierarchy.labelled`` makes of the vocabulary, where the
        catalogue has them stored (broader_labels, broader_others), else level by level."""
        tree = self.vocabulary.select("id", "broader_id")
        named = self.vocabulary.select("id", F.col("vocab_int_id").alias("vocab_rowid"))
        roots = named.join(terms, "vocab_rowid", "left_semi").select("id")
        if {"broader_labels", "broader_others"} <= self.tables.keys():
            below = hierarchy.below(self.broader_labels, self.broader_others, roots, 10)
        else:
            below = hierarchy.descendants(tree, roots, "id", "broader_id")
        return named.join(below, "id", "left_semi").select("vocab_rowid")

    def matching(self, params: dict) -> DataFrame:
        """The artworks that meet every filter; each is one semi-join or predicate. Of an array every value has
        to be met."""
        p = cleaned(params)
        out, c = self.artworks, F.col
        for name in (n for n in p if n in VOCABULARY_FILTERS):
            linked = self.edges(*VOCABULARY_FILTERS[name][0])
            for value in each(p[name]):
                terms = self.terms(name, value)
                if p.get("expandPlaceHierarchy") and VOCABULARY_FILTERS[name][1] == "place":
                    terms = self.with_narrower(terms)
                hit = linked.join(terms, "vocab_rowid", "left_semi").select(c("artwork_id").alias("_a"))
                out = out.join(hit, c("art_id") == c("_a"), "left_semi")
        for pairs, other, column, wanted in (("assignment_pairs", "attributionQualifier", "qualifier_id", True), ("production_role_pairs", "productionRole", "role_id", p.get("sameRowMatching"))):
            if wanted and "creator" in p and other in p and pairs in self.tables:
                out = self._on_one_row(out, self.tables[pairs], p["creator"], other, p[other], column)
        for name in (n for n in p if n in TEXTS):
            pad = T.padded(T.tokens(c(TEXTS[name])))
            for phrase in each(p[name]):
                out = out.where(T.has_phrase(pad, phrase))
        if "textQuery" in p:
            fields = {n: (T.tokens(c(column)), T.padded(T.tokens(c(column)))) for n, column in TEXTS.items() if column in out.columns}
            out = out.where(T.boolean_query(fields, p["textQuery"]))
        if "creationDate" in p:
            years = S.parse_years(str(p["creationDate"]))
            if years is None:
                raise ValueError(f"no years in {p['creationDate']!r}")
            out = out.where(filters.interval(c("date_earliest"), c("date_latest"), *years, p.get("dateMatch", "overlaps")))
        for side in ("Height", "Width"):
            low, high = p.get(f"min{side}"), p.get(f"max{side}")
            if low is not None or high is not None:
                out = out.where(filters.measured(c(f"{side.lower()}_cm"), low, high))
        if "objectNumber" in p:
            out = out.where(filters.glob(c("object_number"), p["objectNumber"]))
        if "imageAvailable" in p:
            out = out.where((c("has_image") == 1) == bool(p["imageAvailable"]))
        if "hasDimensions" in p:
            some = F.coalesce(c("height_cm"), c("width_cm")).isNotNull()
            out = out.where(some if p["hasDimensions"] else ~some)
        if at := self.point(p):
            out = out.join(self.near(at, p.get("nearPlaceRadius", 25)), "art_id", "left_semi")
        for name in (n for n in p if n in PRESENCE):
            out = filters.presence(out, self.tables[PRESENCE[name]], "art_id", "art_id" if "art_id" in self.tables[PRESENCE[name]].columns else "artwork_id", p[name])
        for name in (n for n in p if n in FILLED):
            some = F.coalesce(c(FILLED[name]), F.lit("")) != ""
            out = out.where(some if p[name] else ~some)
        for rows, names, test in (("provenance_events", EVENTS, condition), ("provenance_parties", PARTIES, party_condition)):
            if facets := {names[n]: p[n] for n in names if n in p}:
                out = filters.same_row(out, self.tables[rows], "art_id", "artwork_id", test(**facets))
        for name in (n for n in p if n in LINKED):
            linked = self._linked(name, p[name]).toDF("_k")
            out = out.join(linked, c("art_id") == c("_k"), "left_anti" if p[name] is False else "left_semi")
        return out

    def _linked(self, name: str, value) -> DataFrame:
        """(artwork_id) of works that a filter over other tables means: a creator of a gender, a place of production of a
        type (by name or URI), an exhibition by its title, a term with other names, a creator known elsewhere."""
        v, c = self.vocabulary, F.col
        ids = lambda rows: rows.select(c("vocab_int_id").alias("vocab_rowid"))
        if name == "exhibition":
            shown = self.exhibitions.where(filters.substring(F.coalesce("title_en", "title_nl"), str(value))).select("exhibition_id")
            return self.artwork_exhibitions.join(shown, "exhibition_id", "left_semi").select("art_id")
        if name == "gender":
            return self.edges("creator").join(ids(v.where(c("gender") == value)), "vocab_rowid", "left_semi").select("artwork_id")
        if name == "hasWikidataCreator":
            return self.edges("creator").join(ids(v.where("wikidata_id is not null")), "vocab_rowid", "left_semi").select("artwork_id")
        if name == "hasAltNames":
            named = v.join(self.entity_alt_names.select(c("entity_id").alias("id")), "id", "left_semi")
            return self.mappings.join(ids(named), "vocab_rowid", "left_semi").select("artwork_id")
        places = v.where(c("placetype") == value)
        if "placetypes" in self.tables:
            called = self.placetypes.where(F.lower("label") == str(value).lower()).select(c("uri").alias("placetype"))
            places = places.unionByName(v.join(called, "placetype", "left_semi").select(v.columns))
        return self.edges("spatial").join(ids(places), "vocab_rowid", "left_semi").select("artwork_id")

    def total(self, params: dict) -> DataFrame:
        """(total): how many artworks match, pages aside."""
        return self.matching(params).agg(F.count("*").alias("total"))

    def point(self, p: dict) -> tuple[float, float] | None:
        """The coordinates that a query names, by number or by place; none named: None."""
        if "nearLat" in p and "nearLon" in p:
            return float(p["nearLat"]), float(p["nearLon"])
        if "nearPlace" not in p:
            return None
        if (found := self.located(p["nearPlace"])) is None:
            raise ValueError(f"no place with coordinates is called {p['nearPlace']!r}")
        return found["lat"], found["lon"]

    def located(self, name: str):
        """The place (id, label, lat, lon) that a name means: of those whose label has the phrase the one with the
        shortest label; without any, the name is tried without its last word. What follows a comma names a place to be
        near to: of several the shortest label within 100 km of it, else the nearest. None: None."""
        places = self.vocabulary.where("type = 'place' and lat is not null and lon is not null").select("id", F.explode(F.array("label_en", "label_nl")).alias("label"), "lat", "lon").where("label <> ''")
        first, _, rest = name.partition(",")
        pad, tried = T.padded(T.tokens(F.col("label"))), first.split()
        around = self.located(rest.strip()) if rest.strip() else None
        order = [F.length("label"), F.col("label"), F.col("id")]
        if around:
            km = S.haversine_km(F.lit(around["lat"]), F.lit(around["lon"]), F.col("lat"), F.col("lon"))
            order = [F.when(km <= 100, 0.0).otherwise(km), *order]
        for phrase in dict.fromkeys([name, *(" ".join(tried[:n]) for n in range(len(tried), 0, -1))]):
            found = places.where(T.has_phrase(pad, phrase)).orderBy(*order).limit(1).collect()
            if found:
                return found[0]
        return None

    def near(self, at: tuple[float, float], km: float = 25.0) -> DataFrame:
        """(art_id, place, km): artworks that show or name a place within a radius, with the nearest; areas are no
        places to be near to."""
        places = self.vocabulary.where("type = 'place'")
        if "is_areal" in places.columns:
            places = places.where(~F.coalesce(F.col("is_areal"), F.lit(False)))
        close = filters.near_point(places, "lat", "lon", at, km).select(F.col("vocab_int_id").alias("vocab_rowid"), F.coalesce(F.nullif("label_en", F.lit("")), "label_nl").alias("place"), "km")
        linked = self.edges("subject", "spatial").join(close, "vocab_rowid")
        return linked.groupBy(F.col("artwork_id").alias("art_id")).agg(F.min(F.struct("km", "place")).alias("_m")).select("art_id", "_m.place", "_m.km")

    def search_near(self, params: dict, slice_size: int | None = None) -> DataFrame:
        """Matches near a place, nearest first, with the nearest place and its distance; with ``slice_size`` among the
        most important only (ten pages at least)."""
        p = cleaned(params)
        most, offset = min(100, int(p.get("maxResults", 25))), int(p.get("offset", 0))
        out = self.matching(p).join(self.near(self.point(p), p.get("nearPlaceRadius", 25)), "art_id")
        order = [F.col("importance").desc_nulls_last()] if "importance" in out.columns else []
        first = out.orderBy(*order, "art_id").limit(max(10 * (most + offset), slice_size)) if slice_size else out
        return first.orderBy("km", "art_id").offset(offset).limit(most).select("object_number", "title", F.col("place").alias("nearest_place"), F.round("km", 1).alias("distance_km"))

    def _on_one_row(self, out: DataFrame, pairs: DataFrame, creators, other: str, others, column: str) -> DataFrame:
        """Artworks with one pair row that has both the creator and the role or qualifier."""
        named = self.vocabulary.select("id", F.col("vocab_int_id").alias("vocab_rowid"))
        for creator in each(creators):
            for value in each(others):
                who = named.join(self.terms("creator", creator), "vocab_rowid", "left_semi").select(F.col("id").alias("creator_id"))
                what = named.join(self.terms(other, value), "vocab_rowid", "left_semi").select(F.col("id").alias(column))
                hit = pairs.join(who, "creator_id", "left_semi").join(what, column, "left_semi").select(F.col("artwork_id").alias("_a"))
                out = out.join(hit, F.col("art_id") == F.col("_a"), "left_semi")
        return out

    def search(self, params: dict) -> DataFrame:
        """A page of matches: by the sort key with nulls last, else by text rank, else by importance; then by id."""
        p = cleaned(params)
        out, order = self.matching(p), []
        text_filter = next((n for n in p if n in TEXTS), None)
        if p.get("sortBy"):
            if p["sortBy"] not in SORTS:
                raise ValueError(f"unknown sort key {p['sortBy']!r}")
            key = F.nullif(F.col(SORTS[p["sortBy"]]), F.lit(0)) if p["sortBy"] in ("height", "width") else F.col(SORTS[p["sortBy"]])
            order = [key.asc_nulls_last() if p.get("sortOrder") == "asc" else key.desc_nulls_last()]
        elif text_filter:
            rank = text.bm25(self.artworks, "art_id", [TEXTS[n] for n in TEXTS if TEXTS[n] in self.artworks.columns], each(p[text_filter]), [TEXTS[text_filter]])
            out, order = out.join(rank, "art_id", "left"), [F.col("score").asc_nulls_last()]
        elif "importance" in out.columns:
            order = [F.col("importance").desc_nulls_last()]
        page = out.orderBy(*order, "art_id").offset(int(p.get("offset", 0))).limit(min(100, int(p.get("maxResults", 25))))
        return page.select("object_number", "art_id", "title", F.col("creator_label").alias("creator"), S.date_range_label(F.col("date_earliest"), F.col("date_latest")).alias("date"))

    def labelled(self, field: str) -> DataFrame:
        """(art_id, label) of the edges in a field, English before Dutch."""
        label = F.coalesce(F.nullif("label_en", F.lit("")), "label_nl").alias("label")
        return self.edges(field).join(self.vocabulary.select(F.col("vocab_int_id").alias("vocab_rowid"), label), "vocab_rowid").select(F.col("artwork_id").alias("art_id"), "label")

    def stats(self, field: str, params: dict | None = None, top: int = 25, offset: int = 0) -> DataFrame:
        """(label, n, pct): a page of a dimension over the artworks that meet the filters, or over all; shares
        are of all these artworks, whether they have a label or not."""
        pool = (self.matching(params) if params else self.artworks).select("art_id")
        total = pool.agg(F.count("*").alias("_total"))
        counted = self.labelled(field).join(pool, "art_id", "left_semi").groupBy("label").agg(F.count_distinct("art_id").alias("n"))
        out = counted.crossJoin(F.broadcast(total)).select("label", "n", F.round(100 * F.col("n") / F.col("_total"), 1).alias("pct"))
        return out.orderBy(F.desc("n"), "label").offset(offset).limit(min(500, top))

    def stats_by(self, bucket: Column, params: dict | None = None) -> DataFrame:
        """(label, n, pct) of a column expression over artworks (a century, a bin of sizes), in order of the label."""
        pool = self.matching(params) if params else self.artworks
        return aggregates.dimension(pool, bucket, "art_id", None).orderBy("label")

    def event_stats(self, bucket: Column, facets: dict | None = None, params: dict | None = None) -> DataFrame:
        """(label, n, pct): artworks by a column of their ownership events, counted over the events that meet the
        facets themselves, so the filter and the bucket stand on one row."""
        rows = self.provenance_events.where(condition(**(facets or {})))
        if params:
            rows = rows.join(self.matching(params).select(F.col("art_id").alias("artwork_id")), "artwork_id", "left_semi")
        return aggregates.dimension(rows, bucket, "artwork_id").orderBy(F.desc("n"), "label")

    def histories(self, facets: dict, without: dict | None = None) -> DataFrame:
        """Whole ownership chains of artworks with an event that meets all facets, events flagged ``matched``;
        optionally without those that have an event which meets ``without``."""
        from vitrine.operators.provenance import chains

        return chains(self.provenance_events, "artwork_id", condition(**facets), condition(**without) if without else None).orderBy("artwork_id", "sequence")

    def history_facets(self, facets: dict, top: int = 20) -> DataFrame:
        """(dim, label, n, pct) of the matching events: type, category, location, currency, decade."""
        c = F.col
        dims = {"transferType": c("transfer_type"), "transferCategory": c("transfer_category"), "location": c("location"), "currency": c("price_currency"), "decade": S.binned(c("date_year"), 10).cast("int").cast("string")}
        return aggregates.facets(self.provenance_events.where(condition(**facets)), dims, top)

    def inscribed(self, exclude_mark_only: bool = False, **facets) -> DataFrame:
        """(art_id, n_matched, matched): artworks with an inscription that meets all facets at once."""
        from vitrine.operators import inscriptions

        found = inscriptions.segments(self.artworks, "art_id", "inscription_text")
        return inscriptions.search(found, "art_id", inscriptions.facets(**facets), exclude_mark_only).orderBy("art_id")

    def credit_lines(self, words: str) -> DataFrame:
        """Artworks without ownership events whose credit line has all the words."""
        pad = T.padded(T.tokens(F.col("credit_line")))
        hit = reduce(Column.__and__, [T.has_phrase(pad, w) for w in T.words_of(words)])
        events = self.provenance_events.select(F.col("artwork_id").alias("art_id"))
        return self.artworks.where(hit).join(events, "art_id", "left_anti").select("object_number", "title", "credit_line").orderBy("object_number")

    def coverage(self, field: str, params: dict | None = None) -> DataFrame:
        pool = (self.matching(params) if params else self.artworks).select("art_id")
        return aggregates.coverage(pool, self.labelled(field), F.col("label"), "art_id", "art_id")

    def facets(self, params: dict, fields: list[str], top: int = 5) -> DataFrame:
        """(dim, label, n, pct) of the matches in several fields in one pass; fields that are filtered on are left out."""
        rows = [self.labelled(f).withColumn("dim", F.lit(f)) for f in fields if f not in params]
        both = reduce(DataFrame.unionByName, rows).join(self.matching(params).select("art_id"), "art_id", "left_semi")
        counted = both.groupBy("dim", "label").agg(F.count_distinct("art_id").alias("n"))
        share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("dim")), 1)
        return aggregates.top_per_group(counted.withColumn("pct", share), "dim", "label", "n", top).select("dim", "label", "n", "pct")

    def nearest(self, query: list[float], k: int = 25, params: dict | None = None) -> DataFrame:
        """(art_id, distance) of the k nearest artworks by their vectors, among those that meet the filters."""
        eligible = self.matching(params).select("art_id") if params else None
        return vector.knn(self.artwork_embeddings, query, k, "art_id", "embedding", eligible)

    def similar_by(self, channel: str, art_id: int, top: int = 25, strength: dict[str, float] | None = None) -> DataFrame:
        """(entity, score) of artworks like one, by one channel, best first. ``strength``: what a qualifier of an
        attribution weighs, for lineage. Visual candidates are a table (art_id, other_id, score)."""
        v = self.vocabulary
        subjects = self.edges("subject").join(v.select(F.col("vocab_int_id").alias("vocab_rowid"), "type", "notation"), "vocab_rowid")
        if channel == "iconclass":
            rows = subjects.where("notation is not null").withColumn("_w", F.length("notation"))
            found = similar.notation_overlap(rows, art_id, "artwork_id", "notation")
        elif channel == "depictedPerson":
            found = similar.idf_overlap(subjects.where("type = 'person' and notation is null"), art_id, "artwork_id", "vocab_rowid")
        elif channel == "depictedPlace":
            places = self.edges("subject", "spatial").join(v.where("type = 'place'").select(F.col("vocab_int_id").alias("vocab_rowid")), "vocab_rowid", "left_semi")
            broad = v.groupBy(F.col("broader_id").alias("id")).count().where("count > 20").join(v.select("id", "vocab_int_id"), "id").select("vocab_int_id")
            found = similar.idf_overlap(places, art_id, "artwork_id", "vocab_rowid", exclude=broad)
        elif channel == "theme":
            found = similar.idf_overlap(self.edges("theme"), art_id, "artwork_id", "vocab_rowid", least_terms=2)
        elif channel == "related":
            found = similar.edge_tiers(self.related_objects, art_id, "art_id", "related_art_id", "relationship_en", {"different example": 6.0, "production stadia": 6.0, "pendant": 6.0}, 2.0)
        elif channel == "lineage":
            found = similar.pair_overlap(self.assignment_pairs, art_id, "artwork_id", "qualifier_id", "creator_id", strength or {})
        elif channel == "description":
            found = vector.similar_items(self.desc_embeddings, art_id, top, "art_id", "embedding").select(F.col("art_id").alias("entity"), F.col("similarity").alias("score"))
        elif channel == "visual":
            found = self.visual_candidates.where(F.col("art_id") == art_id).groupBy(F.col("other_id").alias("entity")).agg(F.max("score").alias("score"))
        else:
            raise ValueError(f"unknown channel {channel!r}")
        return found.select("entity", "score").orderBy(F.desc("score"), "entity").limit(top)

    def detail(self, object_number: str) -> DataFrame:
        """One row for an artwork: its own columns, labels by field as arrays, and its inscriptions."""
        one = self.artworks.where(F.col("object_number") == object_number)
        names = {"type": "types", "material": "materials", "technique": "techniques", "subject": "subjects", "creator": "creators"}
        by = reduce(DataFrame.unionByName, [self.labelled(f).withColumn("_f", F.lit(n)) for f, n in names.items()]).join(one.select("art_id"), "art_id", "left_semi")
        arrays = by.groupBy("art_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("_f") == n, F.col("label")))).alias(n) for n in names.values()))
        out = one.join(arrays, "art_id", "left").withColumn("inscriptions", F.split("inscription_text", r"\s*\|\s*"))
        return out.withColumn("dimensions", S.dimension_label(F.col("height_cm"), F.col("width_cm")))

    def persons(self, name: str | None = None, gender: str | None = None, born: tuple[int | None, int | None] = (None, None), has_works: bool | None = True, birth_place=None, death_place=None, profession=None, unused: bool = False) -> DataFrame:
        """(id, label, birth_year, death_year, gender, n_works), busiest first. Places and professions are those of the
        artworks that a person made (of several every one); ``unused``: persons who neither made a work nor are shown on one."""
        people = self.vocabulary.where("type = 'person'").withColumn("label", F.coalesce(F.nullif("label_en", F.lit("")), "label_nl"))
        if name:
            people = people.join(self.terms("creator", name).select(F.col("vocab_rowid").alias("vocab_int_id")), "vocab_int_id", "left_semi")
        if gender:
            people = people.where(F.col("gender") == gender)
        for bound, side in zip(born, (">=", "<="), strict=True):
            if bound is not None:
                people = people.where(f"birth_year {side} {int(bound)}")
        for field, values in (("birthPlace", birth_place), ("deathPlace", death_place), ("profession", profession)):
            for value in [] if values is None else each(values):
                known = self.edges(*VOCABULARY_FILTERS[field][0]).join(self.terms(field, value), "vocab_rowid", "left_semi").select("artwork_id")
                makers = self.edges("creator").join(known, "artwork_id", "left_semi").select(F.col("vocab_rowid").alias("vocab_int_id"))
                people = people.join(makers, "vocab_int_id", "left_semi")
        if unused:
            has_works = False
            people = people.join(self.edges("subject").select(F.col("vocab_rowid").alias("vocab_int_id")), "vocab_int_id", "left_anti")
        works = self.edges("creator").groupBy(F.col("vocab_rowid").alias("vocab_int_id")).agg(F.count("*").alias("n_works"))
        out = people.join(works, "vocab_int_id", "left").withColumn("n_works", F.coalesce("n_works", F.lit(0)))
        if has_works is not None:
            out = out.where(F.col("n_works") > 0 if has_works else F.col("n_works") == 0)
        return out.select("id", "label", "birth_year", "death_year", "gender", "n_works").orderBy(F.desc("n_works"), F.lower("label"), "id")

    def sets(self, contains: str | None = None, least: int | None = None, most: int | None = None, order: str = "name") -> DataFrame:
        """(id, label, members) of curated sets, by name, size or sizeDesc."""
        named = self.vocabulary.where("type = 'set'").select("id", F.col("vocab_int_id").alias("vocab_rowid"), F.coalesce(F.nullif("label_en", F.lit("")), "label_nl").alias("label"))
        out = named.join(self.edges("collection_set"), "vocab_rowid", "left").groupBy("id", "label").agg(F.count("artwork_id").alias("members"))
        if contains:
            out = out.where(filters.substring(F.col("label"), contains))
        if least is not None:
            out = out.where(F.col("members") >= least)
        if most is not None:
            out = out.where(F.col("members") <= most)
        by = {"name": [], "size": [F.col("members")], "sizeDesc": [F.desc("members")]}[order]
        return out.orderBy(*by, F.lower("label"), "id")

    def set_page(self, set_id: str, size: int = 50, token: str | None = None) -> tuple[DataFrame, str]:
        """A page of a set's members by object number, and the token of the next page."""
        offset = 0
        if token:
            set_id, offset = S.read_page_token(token)
        own = self.vocabulary.where(F.col("id") == set_id).select(F.col("vocab_int_id").alias("vocab_rowid"))
        members = self.edges("collection_set").join(own, "vocab_rowid", "left_semi").select(F.col("artwork_id").alias("art_id"))
        page = self.artworks.join(members, "art_id", "left_semi").orderBy("object_number").offset(offset).limit(size)
        return page, S.page_token(set_id, offset + size)

    def bibliography(self, object_number: str) -> DataFrame:
        return details.ordered_records(self.artwork_citations, self.artworks.where(F.col("object_number") == object_number), [F.col("seq").asc_nulls_last(), F.col("citation_text")])

    def citing(self, publication_id: int) -> DataFrame:
        """Artworks that cite a publication, each once."""
        hit = self.artwork_citations.where(F.col("publication_id") == publication_id).select("art_id")
        return self.artworks.join(hit, "art_id", "left_semi").select("object_number", "title").orderBy("object_number")

    def conservation(self, object_number: str) -> DataFrame:
        """Examinations and modifications of an artwork, latest first, undated last."""
        one = self.artworks.where(F.col("object_number") == object_number)
        exams = self.examinations.select("art_id", "seq", F.lit("examination").alias("kind"), F.col("report_type_en").alias("what"), "date_begin")
        changes = self.modifications.select("art_id", "seq", F.lit("modification").alias("kind"), F.col("description").alias("what"), "date_begin")
        return details.ordered_records(exams.unionByName(changes), one, [F.col("date_begin").desc_nulls_last(), F.col("kind"), F.col("seq")])


def condition(**facets) -> Column:
    """A condition on one event: transferType (one or several), location, between (years), dateFrom, dateTo, currency,
    party, hasPrice, unsold, uncertain, gap, crossRef, relatedTo, categoryMethod, parseMethod."""
    from vitrine.operators.provenance import party_is

    c, out = F.col, F.lit(True)
    for name, value in facets.items():
        test = {
            "transferType": lambda v: c("transfer_type").isin(*each(v)), "location": lambda v: filters.substring(c("location"), v), "between": lambda v: c("date_year").between(*v),
            "currency": lambda v: c("price_currency") == v, "party": party_is, "unsold": lambda v: c("unsold") == v, "gap": lambda v: c("gap") == v, "hasPrice": lambda v: c("price_amount").isNotNull() == v,
            "dateFrom": lambda v: c("date_year") >= int(v), "dateTo": lambda v: c("date_year") <= int(v), "uncertain": lambda v: c("uncertain") == v, "crossRef": lambda v: c("is_cross_ref") == v, "relatedTo": lambda v: c("cross_ref_target") == v,
            "categoryMethod": lambda v: c("category_method") == v, "parseMethod": lambda v: c("parse_method") == v,
        }.get(name)
        if test is None:
            raise ValueError(f"unknown condition {name!r}")
        out = out & test(value)
    return F.coalesce(out, F.lit(False))


def party_condition(party: str | None = None, positionMethod: str | None = None, partyRole: str | None = None) -> Column:  # noqa: N803
    """A condition on one party's row: part of its name, how its position was found, its role."""
    out = F.lit(True)
    if party:
        out = out & filters.substring(F.col("party_name"), party)
    if positionMethod:
        out = out & (F.col("position_method") == positionMethod)
    if partyRole:
        out = out & (F.col("party_role") == partyRole)
    return F.coalesce(out, F.lit(False))
