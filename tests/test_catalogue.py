"""A small catalogue, and what its queries have to give."""

import pytest

from vitrine.catalogue import Catalogue, cleaned
from vitrine.operators import provenance

FIELDS = ["type", "material", "creator", "production_role", "subject", "spatial", "collection_set", "theme", "attribution_qualifier"]
TERMS = [
    ("t-paint", "classification", "painting", "schilderij", 11, None, None), ("t-print", "classification", "print", "prent", 12, None, None), ("t-canvas", "classification", "canvas", "doek", 13, None, None),
    ("t-anna", "person", "Anna van Oord", "Anna van Oord", 14, None, None), ("t-delft", "place", "Delft", "Delft", 21, None, "t-holland"), ("t-holland", "place", "Holland", "Holland", 22, None, None),
    ("t-master", "person", "Old Master", "Old Master", 31, None, None), ("9032", "person", "Photographer", "Fotograaf", 32, None, None), ("t-by", "classification", "photographed by", "fotograaf", 41, None, None), ("t-after", "classification", "after painting by", "naar schilderij van", 42, None, None),
    ("t-prey", "concept", "beasts of prey", "roofdieren", 51, "25F23", None), ("t-saint", "concept", "male saints", "heiligen", 52, "11H", None), ("t-peter", "person", "Peter", "Petrus", 61, None, None), ("t-orange", "person", "William", "Willem", 62, None, None), ("t-maria", "person", "Maria", "Maria", 63, None, None),
    ("t-set", "set", "Prints of Delft", "Prenten van Delft", 71, None, None), ("t-empty", "set", "Empty set", "Leeg", 72, None, None),
]
ART = [
    ("A-1", 1, "The Night Study", "Anna van Oord", "An oil study of a company.", "signatuur, recto: ‘A 1642’ | signature: ‘A’", "Story", 100.0, 80.0, 1640, 1642, 1), ("A-2", 2, "Winter Landscape", "Someone", "Skating on a river.", None, None, 50.0, 40.0, 1608, 1610, 0),
    ("A-3", 3, "Etching of a Mill", "Anonymous", "A mill.", None, None, 20.0, 15.0, 1800, 1850, 1), ("A-4", 4, "Portrait", "Unknown", None, None, None, None, None, None, None, 1), ("A-5", 5, "Map of Delft", "Anonymous", "A printed map.", None, None, 30.0, 25.0, 1650, 1650, 0),
    ("A-6", 6, "Self-Portrait", "Anna van Oord", "In later life.", "aetatis", None, 70.0, 55.0, 1660, 1660, 1), ("A-7", 7, "Tulips", "Someone", "A vase.", None, None, 45.0, 35.0, 1620, 1625, 1), ("A-8", 8, "Lion", "Anonymous", None, None, None, 0.0, None, 1700, 1700, 0), ("A-9", 9, "Reproduction after a Master", "Photographer", "A print.", None, None, 30.0, 24.0, 1865, 1890, 0),
]
#: Artworks by field and term.
LINKS = {
    ("type", "t-paint"): [1, 2, 4, 6, 7], ("type", "t-print"): [3, 5, 8], ("material", "t-canvas"): [1], ("creator", "t-anna"): [1, 6], ("creator", "t-master"): [9], ("creator", "9032"): [9],
    ("production_role", "t-by"): [9], ("production_role", "t-after"): [9], ("collection_set", "t-set"): [3, 5], ("subject", "t-delft"): [5], ("subject", "t-prey"): [1, 2, 7], ("subject", "t-saint"): [1, 2, 3],
    ("subject", "t-peter"): [1, 6], ("subject", "t-orange"): [1, 4, 6], ("subject", "t-maria"): [8],
}
NUMBERS = {t[0]: t[4] for t in TERMS}
EDGES = [(art, NUMBERS[term], FIELDS.index(field) + 1) for (field, term), arts in LINKS.items() for art in arts]


@pytest.fixture(scope="module")
def c(spark):
    make = spark.createDataFrame
    return Catalogue(
        field_lookup=make([(i + 1, n) for i, n in enumerate(FIELDS)], "id int, name string"),
        vocabulary=make([(*t, None, None, None, *((52.0, 4.36) if t[0] == "t-delft" else (52.2, 4.6) if t[0] == "t-holland" else (None, None)), t[0] == "t-holland") for t in TERMS], "id string, type string, label_en string, label_nl string, vocab_int_id long, notation string, broader_id string, birth_year int, death_year int, gender string, lat double, lon double, is_areal boolean"),
        artworks=make([(*a, a[2], "Gift of the heirs Vos" if a[1] in (1, 5) else None) for a in ART], "object_number string, art_id long, title string, creator_label string, description_text string, inscription_text string, narrative_text string, height_cm double, width_cm double, date_earliest int, date_latest int, has_image int, title_all_text string, credit_line string"),
        mappings=make(EDGES, "artwork_id long, vocab_rowid long, field_id int"),
        production_role_pairs=make([(9, "t-master", "t-after", 1), (9, "9032", "t-by", 0)], "artwork_id long, creator_id string, role_id string, part_index int"),
        artwork_citations=make([(1, 2, "B", 7), (1, 1, "A", 7), (1, None, "C", 8), (2, 1, "D", 7)], "art_id long, seq int, citation_text string, publication_id long"),
        examinations=make([(1, 1, "X-ray", "1999-01-01")], "art_id long, seq int, report_type_en string, date_begin string"),
        modifications=make([(1, 1, "cleaned", "2005-02-01"), (1, 2, "framed", None)], "art_id long, seq int, description string, date_begin string"),
        provenance_events=provenance.events(make([(1, "sale Dirk Vos, Delft, 1700, fl. 20; donated by Karel Pos, Paris, 1800"), (2, "on loan from Anna Smit, Delft, 1750; purchased by Karel Pos, London, 1801, £ 5")], "artwork_id long, t string"), "artwork_id", "t"),
        artwork_embeddings=make([(i, [float(i), 1.0]) for i in range(1, 10)], "art_id long, embedding array<float>"),
    )


def found(df):
    return [r["object_number"] for r in df.collect()]


@pytest.mark.parametrize(("params", "wanted"), [
    ({"type": ["painting"]}, [1, 2, 4, 6, 7]), ({"type": "print"}, [3, 5, 8]), ({"type": "prent"}, [3, 5, 8]), ({"material": "canvas"}, [1]), ({"creator": "Anna van Oord"}, [1, 6]), ({"creator": "9032"}, [9]), ({"creator": "14"}, []),
    ({"type": "painting", "creationDate": "1642"}, [1]), ({"creationDate": "16*", "dateMatch": "within"}, [1, 2, 5, 6, 7]), ({"creationDate": "1641", "dateMatch": "midpoint"}, [1]), ({"minHeight": 60}, [1, 6]), ({"maxHeight": 30}, [3, 5, 9]),
    ({"type": "print", "imageAvailable": True}, [3]), ({"type": "sculpture"}, []), ({"subject": ["beasts of prey", "male saints"]}, [1, 2]), ({"iconclass": "25F23"}, [1, 2, 7]), ({"depictedPlace": "Holland"}, []), ({"depictedPlace": "Holland", "expandPlaceHierarchy": True}, [5]),
    ({"objectNumber": "A-?"}, [1, 2, 3, 4, 5, 6, 7, 8, 9]), ({"hasInscription": True}, [1, 6]), ({"hasNarrative": False, "type": "painting"}, [2, 4, 6, 7]), ({"title": "night study"}, [1]), ({"description": "printed map"}, [5]),
    ({"textQuery": {"must": [{"phrase": "a"}], "mustNot": [{"phrase": "mill"}]}}, [2, 5, 6, 7, 9]), ({"creator": "Old Master", "productionRole": "photographed by"}, [9]), ({"creator": "Old Master", "productionRole": "photographed by", "sameRowMatching": True}, []), ({"creator": "Old Master", "productionRole": "after painting by", "sameRowMatching": "true"}, [9]),
])
def test_search(c, params, wanted):
    if "textQuery" in params:
        wanted = [a[1] for a in ART if any(" a " in f" {(t or '').lower().replace('.', ' ').replace('‘', ' ').replace('’', ' ')} " for t in (a[2], a[4], a[5], a[6])) and not any("mill " in f"{(t or '').lower().replace('.', ' ')} " for t in (a[2], a[4], a[5], a[6]))]
    assert sorted(found(c.search({**params, "maxResults": 50}))) == [f"A-{i}" for i in wanted]


def test_order_and_pages(c):
    assert found(c.search({"type": "painting", "sortBy": "height"})) == ["A-1", "A-6", "A-2", "A-7", "A-4"]
    assert found(c.search({"type": "painting", "sortBy": "height", "sortOrder": "asc"})) == ["A-7", "A-2", "A-6", "A-1", "A-4"]
    assert found(c.search({"type": "painting", "maxResults": 2})) == ["A-1", "A-2"] and found(c.search({"type": "painting", "maxResults": 2, "offset": 2})) == ["A-4", "A-6"]
    assert [r["date"] for r in c.search({"type": "painting", "sortBy": "dateEarliest", "sortOrder": "asc"}).collect()] == ["1608–1610", "1620–1625", "1640–1642", "1660", None]


def test_parameters(c):
    assert cleaned({"type": " painting ", "imageAvailable": "true", "title": "", "creator": None, "maxResults": 5}) == {"type": "painting", "imageAvailable": True, "maxResults": 5}
    for bad in ({}, {"imageAvailable": True}, {"colour": "red"}, {"type": None}):
        with pytest.raises(ValueError):
            cleaned(bad)
    with pytest.raises(ValueError):
        c.search({"type": "print", "creationDate": "soon"})
    with pytest.raises(ValueError):
        c.search({"type": "print", "sortBy": "weight"})


def test_statistics(c):
    assert [tuple(r) for r in c.stats("type").collect()] == [("painting", 5, 55.6), ("print", 3, 33.3)]
    assert [tuple(r) for r in c.stats("subject", {"type": "print"}).collect()] == [("Delft", 1, 33.3), ("Maria", 1, 33.3), ("male saints", 1, 33.3)]
    assert [tuple(r) for r in c.stats("type", top=1, offset=1).collect()] == [("print", 3, 33.3)]
    assert c.coverage("material").first().asDict() == {"with_bucket": 1, "without_bucket": 8, "total_buckets": 1}
    facets = {(r["dim"], r["label"]): r["n"] for r in c.facets({"type": "painting"}, ["type", "creator", "material"]).collect()}
    assert facets == {("creator", "Anna van Oord"): 2, ("material", "canvas"): 1}


def test_similar(c):
    icon = c.similar_by("iconclass", 1).collect()
    assert [r["entity"] for r in icon] == [2, 7] and icon[0]["score"] > icon[1]["score"]
    people = c.similar_by("depictedPerson", 1).collect()
    assert [r["entity"] for r in people] == [6, 4]
    assert c.similar_by("theme", 1).count() == 0
    assert [r["art_id"] for r in c.nearest([1.0, 1.0], 2).collect()] == [1, 2]
    assert [r["art_id"] for r in c.nearest([1.0, 1.0], 1, {"type": "print"}).collect()] == [3]
    assert c.nearest([1.0, 1.0], 5, {"type": "sculpture"}).count() == 0


def test_details_people_sets_records(c):
    d = c.detail("A-1").first()
    assert (d["types"], d["materials"], d["dimensions"]) == (["painting"], ["canvas"], "h 100.0 cm × w 80.0 cm") and len(d["inscriptions"]) == 2
    assert [(r["label"], r["n_works"]) for r in c.persons().collect()] == [("Anna van Oord", 2), ("Old Master", 1), ("Photographer", 1)]
    assert [r["label"] for r in c.persons(name="Maria", has_works=False).collect()] == ["Maria"]
    assert [(r["label"], r["members"]) for r in c.sets().collect()] == [("Empty set", 0), ("Prints of Delft", 2)] and c.sets("delft", least=3).count() == 0
    page, token = c.set_page("t-set", 1)
    assert found(page) == ["A-3"] and found(c.set_page("", 1, token)[0]) == ["A-5"]
    assert [(r["citation_text"], r["total"]) for r in c.bibliography("A-1").collect()] == [("A", 3), ("B", 3), ("C", 3)]
    assert found(c.citing(7)) == ["A-1", "A-2"]
    assert [r["what"] for r in c.conservation("A-1").collect()] == ["cleaned", "X-ray", "framed"]


def test_near_places(c):
    assert found(c.search({"nearLat": 52.01, "nearLon": 4.35, "nearPlaceRadius": 10})) == ["A-5"] and found(c.search({"nearPlace": "Delft, Holland"})) == ["A-5"]
    assert found(c.search({"nearLat": 10.0, "nearLon": 4.35})) == []
    assert c.located("Delft harbour at night")["label"] == "Delft" and c.located("Nowhere") is None
    row = c.search_near({"nearLat": 52.01, "nearLon": 4.35}).first()
    assert (row["object_number"], row["nearest_place"]) == ("A-5", "Delft") and 1 < row["distance_km"] < 2
    with pytest.raises(ValueError):
        c.search({"nearPlace": "Nowhere"})


def test_histories_and_inscriptions(c):
    from pyspark.sql import functions as F

    from vitrine.functions import scalar as S

    flags = [(r["artwork_id"], r["sequence"], r["matched"]) for r in c.histories({"transferType": "sale", "location": "delft"}).collect()]
    assert flags == [(1, 1, True), (1, 2, False)]
    assert {r["artwork_id"] for r in c.histories({"party": "karel"}, without={"transferType": ["loan"]}).collect()} == {1}
    assert {r["artwork_id"] for r in c.histories({"between": (1790, 1810), "hasPrice": True}).collect()} == {2}
    assert {(r["dim"], r["label"]): r["n"] for r in c.history_facets({"transferType": "sale"}).collect()}["location", "Delft"] == 1
    assert [tuple(r) for r in c.event_stats(F.col("location"), {"transferType": ["sale", "loan"]}).collect()] == [("Delft", 2, 100.0), ("London", 1, 50.0)]
    assert [r["label"] for r in c.stats_by(S.floor_century(F.col("date_earliest")), {"type": "painting"}).collect()] == [1600]
    assert [(r["art_id"], r["n_matched"]) for r in c.inscribed(types=["signature"], placements=["recto"]).collect()] == [(1, 1)]
    assert found(c.credit_lines("heirs gift")) == ["A-5"]
    with pytest.raises(ValueError):
        c.histories({"colour": "red"})
