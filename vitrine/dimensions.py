"""Dimensions of a catalogue's statistics: where the labels of each come from, and what a reader of the counts has
to know about it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.catalogue import EVENTS, PARTIES, VOCABULARY_FILTERS, Catalogue, cleaned, condition, party_condition
from vitrine.functions import scalar as S


@dataclass(frozen=True)
class Dimension:
    """``source``: artworks, edges, people (creators), places, exhibitions, events or parties; ``column``: what is
    counted there; ``unit`` and ``width`` of binned ones (no width: the caller's); ``domain``: years that count."""

    source: str
    column: str
    unit: str | None = None
    width: int | None = None
    domain: tuple[int, int] | None = None
    by_count: bool | None = None

    def described(self, name: str) -> dict:
        """Whether a work may be in several buckets (shares then add up to more than 100), what a bucket is, how
        buckets are ordered, and their unit, width and bounds."""
        per_person = self.source == "people" or name == "creator"
        per_work = name in ("profession", "birthPlace", "deathPlace")
        return {
            "name": name, "multi_valued": self.source != "artworks", "grouping_key": "computed_bucket" if self.unit else "entity" if self.source == "exhibitions" else "label",
            "default_ordering": "count_desc" if self.counted_first else "label_asc", "bucket_unit": self.unit, "bucket_width": self.width, "bucket_min": self.domain and self.domain[0],
            "bucket_max_exclusive": self.domain and self.domain[1], "creator_domain": "person-row" if per_person else "artwork-level" if per_work else None,
        }

    @property
    def counted_first(self) -> bool:
        return self.unit is None if self.by_count is None else self.by_count


#: The vocabulary dimensions, and the columns of the others.
LABELS = "type material technique creator depictedPerson depictedPlace productionPlace subject sourceType theme productionRole profession birthPlace deathPlace".split()
DIMENSIONS = {
    **{name: Dimension("edges", name) for name in LABELS},
    "century": Dimension("artworks", "date_earliest", "year", 100, by_count=True), "decade": Dimension("artworks", "date_earliest", "year"), "height": Dimension("artworks", "height_cm", "cm"), "width": Dimension("artworks", "width_cm", "cm"),
    "decadeModified": Dimension("artworks", "record_modified", "year", 10, (1990, 2030)), "exhibition": Dimension("exhibitions", "title"), "gender": Dimension("people", "gender"),
    "creatorBirthDecade": Dimension("people", "birth_year", "year"), "creatorBirthCentury": Dimension("people", "birth_year", "year", 100), "placeType": Dimension("places", "placetype"),
    "provenanceDecade": Dimension("events", "date_year", "year"), "transferType": Dimension("events", "transfer_type"), "transferCategory": Dimension("events", "transfer_category"), "provenanceLocation": Dimension("events", "location"),
    "currency": Dimension("events", "price_currency"), "categoryMethod": Dimension("events", "category_method"), "parseMethod": Dimension("events", "parse_method"), "party": Dimension("parties", "party_name"),
    "partyPosition": Dimension("parties", "party_position"), "positionMethod": Dimension("parties", "position_method"), "partyRole": Dimension("parties", "party_role"),
}


def described() -> list[dict]:
    return [d.described(name) for name, d in DIMENSIONS.items()]


def labelled(c: Catalogue, name: str, params: dict, width: float | None = None) -> DataFrame:
    """(art_id, label) of a dimension. Filters on events, parties and the creator's gender hold on the rows that are
    counted, not just somewhere on the same work; null labels are no bucket."""
    d, col = DIMENSIONS[name], F.col
    term = lambda *columns: c.vocabulary.select(col("vocab_int_id").alias("vocab_rowid"), *columns)
    of_rows = lambda names: {names[n]: params[n] for n in names if n in params}
    if d.source == "edges":
        fields, kind = VOCABULARY_FILTERS.get(name, ((name,), None))
        terms = term(F.coalesce(F.nullif("label_en", F.lit("")), "label_nl").alias("_v"), "type", "gender")
        terms = terms.where(col("type") == kind) if kind else terms
        if name == "creator" and "gender" in params:
            terms = terms.where(col("gender") == params["gender"])
        rows = c.edges(*fields).join(terms, "vocab_rowid")
    elif d.source == "people":
        people = term(d.column, *([] if d.column == "gender" else ["gender"]))
        rows = c.edges("creator").join(people.where(col("gender") == params["gender"]) if "gender" in params else people, "vocab_rowid")
    elif d.source == "places":
        rows = c.edges("spatial").join(term("placetype"), "vocab_rowid")
        if "placetypes" in c.tables:
            rows = rows.join(c.placetypes.select(col("uri").alias("placetype"), col("label").alias("_called")), "placetype", "left").withColumn("placetype", F.coalesce("_called", "placetype"))
    elif d.source == "exhibitions":
        rows = c.artwork_exhibitions.withColumnRenamed("art_id", "artwork_id").join(c.exhibitions.select("exhibition_id", F.coalesce("title_en", "title_nl").alias("title")), "exhibition_id")
    elif d.source == "events":
        rows = c.provenance_events.where(condition(**of_rows(EVENTS)))
    elif d.source == "parties":
        rows = c.provenance_parties.where(party_condition(**of_rows(PARTIES)))
    else:
        rows = c.artworks.withColumnRenamed("art_id", "artwork_id")
    value = col("_v") if d.source == "edges" else col(d.column)
    if d.unit:
        value = S.iso_year(value) if name == "decadeModified" else F.nullif(value, F.lit(0)) if d.unit == "cm" else value
        if d.domain:
            value = F.when((value >= d.domain[0]) & (value < d.domain[1]), value)
        step = d.width or width or 10
        value = F.floor(value / step) * step
    return rows.select(col("artwork_id").alias("art_id"), value.cast("string").alias("label")).where("label is not null")


def counted(c: Catalogue, name: str, params: dict | None = None, top: int = 25, offset: int = 0, width: float | None = None, order: str | None = None) -> DataFrame:
    """(label, n, pct): a page of a dimension over the works that meet the filters, or over all; shares are of all
    these works. ``order``: count_desc or label_asc; bins go by their number."""
    if name not in DIMENSIONS:
        raise ValueError(f"unknown dimension {name!r}")
    p = cleaned(params) if params else {}
    pool = (c.matching(p) if p else c.artworks).select("art_id")
    rows = labelled(c, name, p, width)
    if p:
        rows = rows.join(pool, "art_id", "left_semi")
    out = rows.groupBy("label").agg(F.count_distinct("art_id").alias("n")).crossJoin(F.broadcast(pool.agg(F.count("*").alias("_all"))))
    out = out.select("label", "n", F.round(100 * F.col("n") / F.col("_all"), 1).alias("pct"))
    by_count = DIMENSIONS[name].counted_first if order is None else order == "count_desc"
    by_label = [F.col("label").try_cast("double"), F.col("label")]
    return out.orderBy(*([F.desc("n")] if by_count else []), *by_label).offset(offset).limit(min(500, top))
