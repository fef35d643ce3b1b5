"""Searches, statistics, people, sets, likeness and ownership over the museum's catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine import dimensions, ownership
from vitrine.catalogue import Catalogue
from vitrine.plans.museum import FIELDS, catalogue, over
from vitrine.plans.registry import Tables, query


def asked(sql: str):
    """Registers a question to the catalogue."""

    def add(f):
        def run(t: Tables):
            return f(catalogue(t))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(over(sql))(run)

    return add


def found(params: dict):
    return lambda c: c.matching(params).select("art_id", "object_number")


def filtered(name: str, params: dict, where: str) -> None:
    """Registers a search by filters under a name."""
    f = found(params)
    f.__name__ = name
    asked(f"select art_id, object_number from artworks where {where}")(f)


def linked(field: str, terms: str) -> str:
    return f"art_id in (select artwork_id from mappings where field_id = {FIELDS.index(field) + 1} and vocab_rowid in (select vocab_int_id from vocabulary where {terms}))"


filtered("flt_name_words", {"creator": "Meer van Anna"}, linked("creator", "label_en like 'Anna van der Meer %'"))
filtered("flt_name_variants", {"creator": "meester 8"}, linked("creator", "id = '1000008'"))
filtered("flt_organisation_names", {"creator": "atelier 10"}, linked("creator", "id = '1000010'"))
filtered("flt_person_id", {"creator": "1000005"}, linked("creator", "id = '1000005'"))
filtered("flt_notation_digits", {"iconclass": "8305"}, linked("subject", "notation = '8305'"))
filtered("flt_no_such_term", {"creator": "nobody whatsoever"}, "false")
filtered("flt_date_wildcard", {"creationDate": "16*"}, "date_earliest <= 1699 and date_latest >= 1600")
filtered("flt_date_midpoint", {"creationDate": "164*", "dateMatch": "midpoint"}, "(date_earliest + date_latest) between 3280 and 3298")
filtered("flt_image_and_title", {"imageAvailable": True, "title": "gear"}, "has_image = 1 and regexp_matches(title, '\\bgear\\b')")
filtered("flt_text_columns", {"description": "small", "curatorialNarrative": "widget"}, "description_text = 'small' and regexp_matches(narrative_text, '\\bwidget\\b')")
filtered("flt_gender", {"gender": "female"}, linked("creator", "gender = 'female'"))
filtered("flt_place_type_by_name", {"placeType": "City"}, linked("spatial", "placetype = 'aat:1'"))
filtered("flt_place_type_by_uri", {"placeType": "aat:2"}, linked("spatial", "placetype = 'aat:2'"))
filtered("flt_exhibition_title", {"exhibition": "zaal"}, "art_id in (select art_id from artwork_exhibitions join exhibitions using (exhibition_id) where coalesce(title_en, title_nl) ilike '%zaal%')")
filtered("flt_with_other_names", {"hasAltNames": True}, "art_id in (select artwork_id from mappings join vocabulary on vocab_int_id = vocab_rowid where id in (select entity_id from entity_alt_names))")
filtered("flt_without_known_creator", {"hasWikidataCreator": False}, "not " + linked("creator", "wikidata_id is not null"))
filtered("flt_event_row", {"transferType": "sale", "provenanceLocation": "city 3", "provenanceDateFrom": 1996, "provenanceDateTo": 1999, "categoryMethod": "type_mapping", "parseMethod": "peg"}, "art_id in (select artwork_id from provenance_events where transfer_type = 'sale' and location = 'City 3' and date_year between 1996 and 1999 and category_method = 'type_mapping' and parse_method = 'peg')")
filtered("flt_event_flags", {"unsold": True, "uncertain": False, "gap": True, "crossRef": False}, "art_id in (select artwork_id from provenance_events where unsold and not uncertain and gap and not is_cross_ref)")
filtered("flt_party_row", {"party": "owner 33", "positionMethod": "role_mapping", "partyRole": "buyer"}, "art_id in (select artwork_id from provenance_parties where party_name ilike '%owner 33%' and position_method = 'role_mapping' and party_role = 'buyer')")


@asked("select count(*) as total from artworks where date_earliest <= 1699 and date_latest >= 1600")
def st_exact_total(c: Catalogue):
    return c.total({"creationDate": "16*", "maxResults": 5})


@asked("select object_number, art_id, title, creator_label as creator, date_earliest || '–' || date_latest as date from artworks where has_image = 1 and height_cm >= 30 order by importance desc, art_id limit 40 offset 20")
def srch_page_by_importance(c: Catalogue):
    return c.search({"minHeight": 30, "imageAvailable": True, "maxResults": 40, "offset": 20})


@asked("select object_number, art_id, title, creator_label as creator, date_earliest || '–' || date_latest as date from artworks where regexp_matches(title, '\\bgear\\b') order by nullif(width_cm, 0) asc nulls last, art_id limit 25")
def srch_page_by_width(c: Catalogue):
    return c.search({"title": "gear", "sortBy": "width", "sortOrder": "asc"})


KM = "2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(lat - 14.0) / 2), 2) + cos(radians(14.0)) * cos(radians(lat)) * power(sin(radians(lon - {lon}) / 2), 2))))"
NEAR = KM.format(lon="(-14.0)")


@asked(f"""select object_number, title, label_en as nearest_place, round(km, 1) as distance_km from (select artwork_id, label_en, {NEAR} as km from mappings join vocabulary on vocab_int_id = vocab_rowid where field_id = 2 and type = 'place')
  join artworks on art_id = artwork_id where km <= 500 order by km, art_id limit 30""")
def srch_near_place(c: Catalogue):
    """The place is the one with the label; nearest first."""
    return c.search_near({"nearPlace": "NATION_12", "nearPlaceRadius": 500, "maxResults": 30})


def share(counted: str, order: str, limit: int = 25) -> str:
    """SQL of a page of a dimension: ``counted`` gives (art_id, label)."""
    return f"select label, count(distinct art_id) as n, round(100.0 * count(distinct art_id) / (select count(*) from artworks), 1) as pct from ({counted}) where label is not null group by label order by {order} limit {limit}"


def dimension(name: str, of: str, counted: str, order: str = "n desc, label", **options) -> None:
    def f(c: Catalogue):
        return dimensions.counted(c, of, **options)

    f.__name__ = name
    asked(share(counted, order))(f)


def labels(field: str, label: str) -> str:
    return f"select artwork_id as art_id, {label} as label from mappings join vocabulary on vocab_int_id = vocab_rowid where field_id = {FIELDS.index(field) + 1}"


dimension("dim_theme", "theme", labels("theme", "label_en"))
dimension("dim_creator", "creator", labels("creator", "label_en"))
dimension("dim_place_type", "placeType", labels("spatial", "case placetype when 'aat:1' then 'city' else 'village' end"))
dimension("dim_gender", "gender", labels("creator", "gender"))
dimension("dim_birth_century", "creatorBirthCentury", labels("creator", "cast(birth_year // 100 * 100 as varchar)"), "label")
dimension("dim_exhibition", "exhibition", "select art_id, coalesce(title_en, title_nl) as label from artwork_exhibitions join exhibitions using (exhibition_id)")
dimension("dim_century", "century", "select art_id, cast(date_earliest // 100 * 100 as varchar) as label from artworks")
for _name, _column in {"transferType": "transfer_type", "transferCategory": "transfer_category", "provenanceLocation": "location", "currency": "price_currency", "categoryMethod": "category_method", "parseMethod": "parse_method", "provenanceDecade": "cast(date_year // 10 * 10 as varchar)"}.items():
    dimension(f"dim_event_{_name}", _name, f"select artwork_id as art_id, {_column} as label from provenance_events", "label" if _name == "provenanceDecade" else "n desc, label")
for _name, _column in {"party": "party_name", "partyPosition": "party_position", "positionMethod": "position_method", "partyRole": "party_role"}.items():
    dimension(f"dim_party_{_name}", _name, f"select artwork_id as art_id, {_column} as label from provenance_parties")


@asked("""select label, count(distinct artwork_id) as n, round(100.0 * count(distinct artwork_id) / (select count(distinct artwork_id) from provenance_parties where party_name ilike '%owner 7%' and party_role = 'buyer'), 1) as pct
  from (select artwork_id, position_method as label from provenance_parties where party_name ilike '%owner 7%' and party_role = 'buyer') group by label""")
def dim_party_filtered(c: Catalogue):
    """The filter holds on the parties that are counted."""
    return dimensions.counted(c, "positionMethod", {"party": "owner 7", "partyRole": "buyer"})


@query("select * from (values " + ", ".join("(" + ", ".join("null" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) for v in d.values()) + ")" for d in dimensions.described()) + ") as d(" + ", ".join(dimensions.described()[0]) + ")")
def dim_described(t):
    """What is to know about every dimension."""
    types = {"multi_valued": "boolean", "bucket_width": "int", "bucket_min": "int", "bucket_max_exclusive": "int"}
    rows = dimensions.described()
    return t.spark.createDataFrame([tuple(d.values()) for d in rows], ", ".join(f"{n} {types.get(n, 'string')}" for n in rows[0]))


CHAINS = """hit as (select e.* from provenance_events e where {test}), per as (select artwork_id, {sort} as sort_value, count(*) as n_matched from hit group by 1 order by sort_value {how} nulls last, artwork_id limit {most})
  select e.artwork_id, e.sequence, coalesce({flag}, false) as matched, cast(per.sort_value as double) as sort_value, n_matched from provenance_events e join per on per.artwork_id = e.artwork_id"""


def chains(name: str, params: dict, test: str, sort: str, how: str, most: int, flag: str | None = None) -> None:
    def f(c: Catalogue):
        return ownership.search_events(c, params).select("artwork_id", "sequence", "matched", "sort_value", "n_matched")

    f.__name__ = name
    asked(", " + CHAINS.format(test=test, sort=sort, how=how, most=most, flag=flag or test))(f)


PARTY = "exists (select 1 from provenance_parties p where p.artwork_id = e.artwork_id and p.sequence = e.sequence and p.party_name ilike '%owner 12%' and p.position_method = 'role_mapping')"
chains("own_by_price", {"transferType": ["sale", "gift"], "location": "city 4", "hasPrice": True, "sortBy": "price"}, "e.transfer_type in ('sale', 'gift') and e.location = 'City 4' and e.price_amount is not null", "max(price_amount)", "desc", 25)
chains("own_by_event_count", {"currency": "guilders", "dateFrom": 1997, "sortBy": "eventCount", "maxResults": 60}, "e.price_currency = 'guilders' and e.date_year >= 1997", "count(*)", "desc", 60)
chains("own_by_first_year", {"categoryMethod": "llm_enrichment", "creator": "brand#7", "sortBy": "dateYear", "sortOrder": "asc"}, "e.category_method = 'llm_enrichment' and e.artwork_id in (select art_id from artworks where creator_label ilike '%brand#7%')", "min(date_year)", "asc", 25, "e.category_method = 'llm_enrichment'")
chains("own_party_and_method", {"party": "owner 12", "positionMethod": "role_mapping"}, PARTY, "null", "asc", 25)
chains("own_without_type", {"dateTo": 1998, "excludeTransferType": "loan", "hasGap": True}, "e.date_year <= 1998 and e.artwork_id not in (select artwork_id from provenance_events where transfer_type = 'loan') and e.artwork_id in (select artwork_id from provenance_events where gap)", "null", "asc", 25, "e.date_year <= 1998")
chains("own_related", {"relatedTo": "P-3"}, "e.cross_ref_target = 'P-3'", "null", "asc", 25)

PERIODS = """, hit as (select * from provenance_periods where {test}), per as (select artwork_id, {sort} as sort_value, count(*) as n_matched from hit group by 1 order by sort_value {how} nulls last, artwork_id limit 25)
  select e.artwork_id, e.sequence, coalesce({test}, false) as matched, cast(per.sort_value as double) as sort_value, n_matched from provenance_periods e join per on per.artwork_id = e.artwork_id"""
LONG = "owner_name ilike '%owner 3%' and acquisition_method = 'gift' and location = 'City 3' and begin_year >= 1960 and end_year <= 2000 and end_year - begin_year >= 5 and end_year - begin_year <= 40"


@asked(PERIODS.format(test=LONG, sort="max(end_year - begin_year)", how="desc"))
def own_periods(c: Catalogue):
    p = {"ownerName": "owner 3", "acquisitionMethod": "gift", "periodLocation": "city 3", "dateFrom": 1960, "dateTo": 2000, "minDuration": 5, "maxDuration": 40, "sortBy": "duration"}
    return ownership.search_periods(c, p).select("artwork_id", "sequence", "matched", "sort_value", "n_matched")


@asked("""select * from (select dim, label, n, round(100.0 * n / sum(n) over (partition by dim), 1) as pct, row_number() over (partition by dim order by n desc, label) as i from (
  select dim, label, count(*) as n from (select unnest(['transferType', 'transferCategory', 'location', 'currency', 'decade']) as dim, unnest([transfer_type, transfer_category, location, price_currency, cast(date_year // 10 * 10 as varchar)]) as label
  from provenance_events where gap and location ilike '%city%') where label is not null group by 1, 2)) where i <= 20""".replace("select * from (select dim", "select dim, label, n, pct from (select dim"))
def own_facets(c: Catalogue):
    return c.history_facets({"gap": True, "location": "city"})


@asked("select object_number, title, credit_line from artworks where credit_line = 'Gift of Brand#3' and art_id not in (select artwork_id from provenance_events where artwork_id is not null)")
def own_credit_lines(c: Catalogue):
    return c.credit_lines("gift brand 3")


PEOPLE = "select id, label_en as label, birth_year, death_year, gender, coalesce(n, 0) as n_works from vocabulary left join (select vocab_rowid, count(distinct artwork_id) as n from mappings where field_id = 1 group by 1) on vocab_rowid = vocab_int_id where type = 'person'"


@asked(f"{PEOPLE} and gender = 'female' and birth_year between 1520 and 1580 and n > 0 and vocab_int_id in (select c.vocab_rowid from mappings c join mappings b on b.artwork_id = c.artwork_id and b.field_id = 7 where c.field_id = 1 and b.vocab_rowid = 32)")
def prs_by_birth_place(c: Catalogue):
    """Women born in a span of years who made works with a birth place."""
    return c.persons(gender="female", born=(1520, 1580), birth_place="NATION_3")


@asked(f"{PEOPLE} and vocab_int_id not in (select vocab_rowid from mappings where field_id in (1, 5))")
def prs_unused(c: Catalogue):
    return c.persons(unused=True)


@asked(f"{PEOPLE} and label_en like 'Jan de Vos %' and n > 0")
def prs_by_name(c: Catalogue):
    return c.persons(name="jan de vos")


@asked("select id, label_en as label, count(distinct artwork_id) as members from vocabulary left join mappings on vocab_rowid = vocab_int_id and field_id = 4 where type = 'set' and label_en ilike '%brand#1%' group by 1, 2 having count(distinct artwork_id) >= 60 order by members desc")
def set_list_by_size(c: Catalogue):
    return c.sets("brand#1", least=60, order="sizeDesc")


@asked("select object_number, title from artworks where creator_label = 'Brand#7' order by object_number limit 20 offset 20")
def set_browse(c: Catalogue):
    """The second page, by the first one's token."""
    _, token = c.set_page("sBrand#7", 20)
    return c.set_page("", 20, token)[0].select("object_number", "title")


def overlap(rows: str, weight: str, seed: int) -> str:
    """SQL of an overlap of terms weighted by rarity: ``rows`` gives (a, t)."""
    return f"""select o.a as entity, {weight} as score from p o join (select t, ln((select count(distinct a) from p) / count(*)::double) as idf from p group by t) i on i.t = o.t
  where o.a <> {seed} and o.t in (select t from p where a = {seed}) group by 1 order by score desc, entity limit 25""".replace("from p", f"from ({rows})")


def alike(name: str, channel: str, seed: int, sql: str, digits: int = 6, **options) -> None:
    def f(c: Catalogue):
        return c.similar_by(channel, seed, **options).select("entity", F.round("score", digits).alias("score"))

    f.__name__ = name
    asked(sql)(f)


alike("alike_by_theme", "theme", 8, overlap("select distinct artwork_id as a, vocab_rowid as t from mappings where field_id = 6", "round(sum(idf), 6)", 8))
alike("alike_by_person", "depictedPerson", 10, overlap("select distinct artwork_id as a, vocab_rowid as t from mappings join vocabulary on vocab_int_id = vocab_rowid where field_id = 5 and type = 'person'", "round(sum(idf), 6)", 10))
alike("alike_by_place", "depictedPlace", 11, overlap("select distinct artwork_id as a, vocab_rowid as t from mappings join vocabulary on vocab_int_id = vocab_rowid where field_id = 2 and type = 'place'", "round(sum(idf), 6)", 11))
LINEAGE = """, p as (select distinct artwork_id as a, qualifier_id as q, creator_id as c from assignment_pairs), i as (select c, ln((select count(distinct a) from p) / count(distinct a)::double) as idf from p group by c)
  select o.a as entity, round(sum(case o.q when 'primary' then 1.0 when 'workshop of' then 0.5 else 0.25 end * idf), 2) as score from p o join p s on s.a = 12 and s.q = o.q and s.c = o.c join i on i.c = o.c where o.a <> 12 group by 1 order by score desc, entity limit 25"""
alike("alike_by_lineage", "lineage", 12, LINEAGE, 2, strength={"primary": 1.0, "workshop of": 0.5, "after": 0.25})


@asked("select art_id, kind, what, date_begin, row_number() over (order by date_begin desc nulls last, kind, seq) as place, count(*) over () as total from (select art_id, seq, 'examination' as kind, report_type_en as what, date_begin from examinations union all select art_id, seq, 'modification', description, date_begin from modifications) where art_id = 3")
def rec_conservation(c: Catalogue):
    return c.conservation("P-3").select("art_id", "kind", "what", "date_begin", "place", "total")


@asked("select art_id, citation_text, row_number() over (order by seq, citation_text) as place, count(*) over () as total from artwork_citations where art_id = 3")
def rec_bibliography(c: Catalogue):
    return c.bibliography("P-3").select("art_id", "citation_text", "place", "total")


@asked("select object_number, title from artworks where art_id in (select art_id from artwork_citations where publication_id = 4)")
def rec_citing(c: Catalogue):
    return c.citing(4)


@asked("""select object_number, 'h ' || height_cm || ' cm' || case when width_cm > 0 then ' × w ' || width_cm || ' cm' else '' end as dimensions, list_aggregate(creators, 'string_agg', '; ') as creators, types from artworks
  join (select artwork_id, list_sort(list(distinct label_en)) as creators from mappings join vocabulary on vocab_int_id = vocab_rowid where field_id = 1 group by 1) c on c.artwork_id = art_id
  join (select artwork_id, max(label_en) as types from mappings join vocabulary on vocab_int_id = vocab_rowid where field_id = 3 group by 1) t on t.artwork_id = art_id where object_number = 'P-17'""")
def rec_detail(c: Catalogue):
    return c.detail("P-17").select("object_number", "dimensions", F.array_join("creators", "; ").alias("creators"), F.array_join("types", "; ").alias("types"))
