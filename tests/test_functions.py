import pytest
from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.functions import text as T
from vitrine.operators import aggregates, details, geo, hierarchy, inscriptions, provenance, ranking, sequences, vector


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "wanted"), [("1642", (1642, 1642)), ("164*", (1640, 1649)), ("16*", (1600, 1699)), ("-5*", (-5999, -5000)), ("-50", (-50, -50)), ("1642*", None), ("soon", None), ("", None)])
def test_years(text, wanted):
    assert S.parse_years(text) == wanted


@pytest.mark.parametrize(("text", "wanted"), [("10-50", (10.0, 50.0)), ("10-", (10.0, None)), ("-50", (None, 50.0)), ("10", (10.0, None)), ("x", None), ("", None), ("-", None)])
def test_ranges(text, wanted):
    assert S.parse_range(text) == wanted


def test_sorts_globs_keys_tokens():
    assert S.parse_sort("-height", {"height"}) == ("height", "desc") and S.parse_sort("height:desc", {"height"}) == ("height", "desc") and S.parse_sort("width", {"height"}) is None
    assert S.glob_pattern("AB-C-*") == r"^AB\-C\-.*$"
    with pytest.raises(ValueError):
        S.glob_pattern("*a")
    assert S.cache_key({"b": 1, "a": [1], "c": None}) == "a=[1]&b=1"
    assert S.read_page_token(S.page_token("set\tx", 50)) == ("set\tx", 50)
    assert [S.ordinal(n) for n in (1, 2, 3, 4, 11, 12, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "21st", "112th"]


def test_scalars(spark):
    L = F.lit
    cases = [
        (S.date_range_label(L(1640), L(1642)), "1640–1642"), (S.date_range_label(L(1640), L(1640)), "1640"), (S.date_range_label(L(None).cast("int"), L(1)), None),
        (S.floor_century(L(1642)), 1600), (S.floor_century(L(-50)), -100), (S.floor_century(L(-100)), -100), (S.floor_century(L(-101)), -200), (S.century_label(L(1642)), "17th century"), (S.century_label(L(-50)), "1st century BCE"), (S.century_span(L(1642)), "1600s"),
        (S.binned(L(-57), 10), -50), (S.binned(L(57), 10), 50), (S.truncated(L("abcdefgh"), 6), "abc..."), (S.truncated(L("abc"), 6), "abc"), (S.snippet(L("one two three"), 9), "one two […]"),
        (S.strip_html(L("<p>a &amp; <b>b</b></p><style>x{}</style> **c**")), "a & b c"), (S.converted(L(12.0), L("mm"), S.LENGTH_CM), 1.2), (S.converted(L(2.0), L("kg"), S.WEIGHT_G), 2000.0), (S.converted(L(2.0), L("ell"), S.LENGTH_CM), None),
        (S.region_valid(S.region(L("pct:10,20,30,40"))), True), (S.region_valid(S.region(L("pct:90,0,20,10"))), False), (S.region(L("full")), None), (S.projected(S.region(L("pct:50,50,10,10")), S.region(L("pct:20,20,40,40")))["x"], 40.0),
        (S.iso_year(L("-0044-03-15")), -44), (S.year_bounds(F.array(L("1640-01-01"), L("1638")), F.array().cast("array<string>"))["latest"], 1638), (S.jaccard(F.array(L(1), L(2)), F.array(L(2), L(3))), pytest.approx(1 / 3)),
        (S.normalised(L(" Émile  Zola! ")), "emile zola"), (F.round(S.haversine_km(L(52.37), L(4.9), L(48.86), L(2.35)), 0), 430.0), (S.authority_of(L("https://www.wikidata.org/entity/Q42"))["id"], "Q42"),
        (details.room_hash(L("HG-1.2-x")), "1.2"), (geo.coordinate_faults(L(0.0), L(0.0)), "null island"), (geo.coordinate_faults(L(4.9), L(52.3), (50.0, 54.0, 3.0, 8.0)), "swapped"), (geo.coordinate_faults(L(91.0), L(0.5)), "range"), (geo.coordinate_faults(L(52.0), L(5.0), (50.0, 54.0, 3.0, 8.0)), "ok"),
    ]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    for i, (_, wanted) in enumerate(cases):
        assert row[f"c{i}"] == wanted, (i, row[f"c{i}"], wanted)


def test_word_forms_and_boolean_queries(spark):
    assert T.variants("ships") == ["ship", "shiping", "shiped"] or "ship" in T.variants("ships")
    assert T.variants("at") == [] and len(sum(T.expanded("red ships sailing"), [])) <= 8 and T.expanded("a b c d") is None
    rows = spark.createDataFrame([(1, "A red ship, sailing home"), (2, "The ship is red"), (3, "Réd ships"), (4, None)], "id int, t string").select("id", T.tokens(F.col("t")).alias("w"))
    rows = rows.withColumn("p", T.padded(F.col("w")))
    field = {"t": (F.col("w"), F.col("p"))}
    ask = lambda q: [r["id"] for r in rows.where(T.boolean_query(field, q)).orderBy("id").collect()]
    assert ask({"must": [{"phrase": "red ship"}]}) == [1] and ask({"must": [{"prefix": "red ship"}]}) == [1, 3] and ask({"should": [{"any": ["home", "ships"]}]}) == [1, 3]
    assert ask({"must": [{"near": {"terms": ["red", "ship"], "distance": 1}}]}) == [1, 2] and ask({"must": [{"near": {"terms": [["ship", "ships"], "red"], "distance": 0}}]}) == [1, 3]
    assert ask({"must": [{"prefix": "ship"}], "mustNot": [{"phrase": "home"}]}) == [2, 3]
    for bad in ({}, {"mustNot": [{"phrase": "x"}]}, {"must": [{}]}, {"must": [{"any": ["x"] * 33}]}, {"maybe": []}):
        with pytest.raises(ValueError):
            T.boolean_query(field, bad)


CHAINS = [
    ("sale Willem Brandsma (1671-1720), Amsterdam, 3 May 1721, no. 14, fl. 126, to Hendrik Loos", dict(transfer_type="sale", date_year=1721, location="Amsterdam", price_amount=126.0, price_currency="guilders")),
    ("? by descent to his son, Jan (1700-1760), Delft, before 1750", dict(transfer_type="by_descent", date_year=1750, date_qualifier="before", uncertain=True)),
    ("donated by Anna Smit to the museum, 1908", dict(transfer_type="gift", date_year=1908)), ("war recuperation, SNK, 1945", dict(transfer_type="recuperation", date_year=1945)),
    ("transferred to the museum, 1960", dict(transfer_type="transfer", date_year=1960)), ("on loan from the City of Delft, since 1885", dict(transfer_type="loan", date_year=1885, date_qualifier="since")),
    ("purchased by Karel Pos, Paris, c. 1820, £ 1,250", dict(transfer_type="sale", date_year=1820, date_qualifier="circa", price_amount=1250.0, price_currency="pounds")), ("commissioned by the guild, 1642", dict(transfer_type="commission", date_year=1642)),
    ("estate inventory, Trijn Mulder (1590-1660), Amsterdam, 2 October 1660", dict(transfer_type="inventory", date_year=1660)), ("Dirk Vos (1620-1670), Delft", dict(transfer_type="unknown", date_year=None)),
    ("his widow, Maria Pos, 1790-1800", dict(transfer_type="widowhood", date_year=1795)), ("unsold, sale Hope, London, 1898", dict(transfer_type="sale", unsold=True)), ("bequeathed to the museum, 1900", dict(transfer_type="bequest", date_year=1900)),
]


def test_events_of_histories(spark):
    rows = provenance.events(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CHAINS)], "id int, t string"), "id", "t").collect()
    found = {r["id"]: r for r in rows}
    for i, (text, wanted) in enumerate(CHAINS):
        assert {k: found[i][k] for k in wanted} == wanted, text
    assert [(p["name"], p["role"], p["position"]) for p in found[0]["parties"]] == [("Willem Brandsma", "seller", "sender"), ("Hendrik Loos", "buyer", "receiver")]


def test_segments_gaps_citations(spark):
    text = "…; ? Anna (a; b), Delft;{Note 1; page 2} Karel, Paris; ...; Jan, 1800{Note 2}"
    rows = provenance.segments(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t").orderBy("id", "sequence").collect()
    assert [(r["sequence"], r["raw_text"].startswith(x)) for r, x in zip(rows, ("? Anna (a; b), Delft", "Karel, Paris", "Jan, 1800"), strict=True)] == [(1, True), (2, True), (3, True)]
    assert rows[0]["gap"] and rows[2]["gap"] and not rows[1]["gap"]
    assert sum((r["citations"] for r in rows), []) == ["Note 1; page 2", "Note 2"]


@pytest.mark.parametrize(("expression", "year", "qualifier", "wanted"), [("before 1750", 1750, "before", (None, 1750, "before_year")), ("after 1750", 1750, "after", (1750, None, "after_year")), ("c. 1750", 1750, "circa", (1740, 1760, "circa_year")), ("1790-95", 1793, None, (1790, 1795, "year_range")), ("by 1700", 1700, "by", (None, 1700, "by_year")), ("1700", 1700, None, (1700, 1700, "exact_year")), (None, None, None, (None, None, "no_date"))])
def test_bounds(spark, expression, year, qualifier, wanted):
    b = one(spark, provenance.bounds(F.lit(expression).cast("string"), F.lit(year).cast("int"), F.lit(qualifier).cast("string")))
    assert (b["earliest"], b["latest"], b["rule"]) == wanted


def test_inscriptions(spark):
    text = "signatuur en datum, rechtsonder, recto, geschilderd: ‘J. Vos f 1642’ | collector's mark, verso, stamped: Lugt 2228a | opschrift, banderole, verso: ‘a &lt;b&gt; c’ | datum | opschrift, verso, potlood: ‘[...]’"
    rows = inscriptions.segments(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t").orderBy("sequence").collect()
    assert [r["normalized_type"] for r in rows] == ["signature and date", "collector's mark", "inscription", "date", "inscription"]
    assert (rows[0]["normalized_placement"], rows[0]["normalized_technique"], rows[0]["transcribed"]) == ("recto", "painted", ["J. Vos f 1642"])
    assert rows[1]["is_collector_mark"] and rows[1]["collector_marks"][0]["number"] == "2228A"
    assert rows[2]["unknown_qualifiers"] == ["banderole"] and rows[2]["transcribed"] == ["a <b> c"] and rows[3]["is_placeholder"]


def test_places_over_all_rows_and_in_groups(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, i % 11) for i in range(200)], "g int, v int").repartition(5)
    for groups in ([], ["g"]):
        found = ranking.places(rows, groups, [F.col("v")]).collect()
        by = {}
        for r in found:
            by.setdefault(tuple(r[g] for g in groups), []).append((r["place"], r["v"], r["group_rows"]))
        for own in by.values():
            own.sort()
            assert [p for p, _, _ in own] == list(range(1, len(own) + 1)) and [v for _, v, _ in own] == sorted(v for _, v, _ in own) and {n for _, _, n in own} == {len(own)}
    assert ranking.places(rows.limit(0), ["g"], [F.col("v")]).count() == 0


def test_trees_with_cycles(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 7)], "id int, up int")
    found = {r["id"]: r["depth"] for r in hierarchy.descendants(tree, spark.createDataFrame([(1,), (5,)], "id int"), "id", "up").collect()}
    assert found == {1: 0, 2: 1, 3: 2, 4: 3, 5: 0, 6: 1}
    ups = {r["id"]: (r["ancestor"], r["depth"]) for r in hierarchy.first_ancestor(tree, "id", "up", F.col("id") == 1).collect()}
    assert ups == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3)}


def test_records(spark):
    make = spark.createDataFrame
    creators = make([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "b"), (3, 1, "a")], "art_id int, place int, creator_id string")
    roles = make([(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (2, 2, "y"), (3, 1, "x"), (3, 2, "y")], "art_id int, place int, role_id string")
    pairs = make([(1, "a", "y", 0), (1, "b", "x", 1)], "art_id int, creator_id string, role_id string, part_index int")
    assert sorted(map(tuple, details.paired_roles(creators, roles, pairs).collect())) == [(1, "a", "y"), (1, "b", "x"), (2, "a", "x"), (2, "b", "y"), (3, "a", None)]
    ids = make([(1, "wikidata", "Q1", "u"), (1, "internal", "7", "u"), (1, "handle", "h", "http://h")], "art_id int, authority string, id string, uri string")
    assert [e["authority"] for e in details.crosswalk(ids, "art_id", {"wikidata": 1, "ulan": 2}).first()["equivalents"]] == ["wikidata"] and details.split_ids(ids, "art_id").first()["handle"] == "http://h"
    assert details.other_names(make([(1, "A"), (1, "B"), (1, "B")], "k int, name string"), make([(1, "A")], "k int, label string"), "k").first()["variants"] == ["B"]
    assert make([("Oil", None, " x ")], "a string, b string, c string").select(details.source_text({"a": "Title", "b": "Creator", "c": "Note"}).alias("t")).first()["t"] == "[Title] Oil [Note] x"
    art = make([(1, 1, "n"), (2, 0, None)], "art_id long, has_image int, narrative_text string")
    assert sorted(map(tuple, details.importance(art, make([(1, 9, 3)] * 25 + [(1, 8, 1)] * 200, "artwork_id long, vocab_rowid long, field_id int"), 3).collect())) == [(1, 126), (2, 0)]
    assert [one(spark, details.category(F.lit(n), F.lit(label), F.lit(s), ["portrait"])) for n, label, s in ((600_000, "x", 0.1), (5, "Album a", 1.0), (5, "x", 0.96), (5, "Portraits", 0.1), (5, "x", 0.1))] == ["umbrella", "album", "object_type", "iconographic", "sub_collection"]
    periods = make([(1, 1600, 1650, False), (1, 1650, None, True), (1, 1700, 1690, False)], "k int, begin_year int, end_year int, uncertain boolean")
    assert tuple(details.period_rollup(periods, "k").first()) == (1, 3, 1600, 1690, 50, True)


def test_vectors_and_sequences(spark):
    assert one(spark, vector.quantised(F.array(F.lit(0.999), F.lit(-2.0), F.lit(0.0)))) == [126, -127, 0]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None)], "id int, e array<double>")
    assert [r["id"] for r in vector.knn(v, [1.0, 0.1], 2, "id", "e").collect()] == [1, 3]
    assert vector.knn(v, [1.0, 0.1], 2, "id", "e", v.select("id").limit(0)).count() == 0
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, ""), (4, "n")], "k int, v string")
    assert sorted(map(tuple, sequences.difference(a, b, "k", ["v"]).collect())) == [(1, "unchanged"), (2, "modified"), (3, "removed"), (4, "new")]
    audit = aggregates.audit(a, [("some", F.col("v").isNotNull(), 1, 5), ("many", F.lit(True), 10, None), ("none", F.col("k") > 9, 1, None)]).collect()
    assert [r["verdict"] for r in audit] == ["PASS", "WARN", "FAIL"]


def test_credit_lines_and_splits(spark):
    make = spark.createDataFrame
    chain = make([(1, 1, "sale A", "sale"), (1, 2, "X and Y", "unknown"), (2, 1, "Z", "unknown")], "id int, sequence int, raw_text string, transfer_type string")
    found = provenance.with_credit_lines(chain, make([(1, "Gift of the heirs, purchase price unknown"), (2, None)], "id int, credit_line string"), "id").orderBy("id", "sequence").collect()
    assert [(r["transfer_type"], r["inferred"], r["transfer_category"]) for r in found] == [("sale", False, "ownership"), ("gift", True, "ownership"), ("unknown", False, "ambiguous")]
    splits = chain.where("raw_text = 'X and Y'").select("id", F.sha2("raw_text", 256).alias("content_hash"), F.array(F.lit("X"), F.lit("Y")).alias("parts"))
    assert [(r["id"], r["sequence"], r["raw_text"]) for r in provenance.split(chain, splits, "id").orderBy("id", "sequence").collect()] == [(1, 1, "sale A"), (1, 2, "X"), (1, 3, "Y"), (2, 1, "Z")]


def test_reconciliation(spark):
    from vitrine.operators import reconcile

    make = spark.createDataFrame
    assert one(spark, reconcile.candidate_score(F.lit(1.0), F.lit(True), F.lit(True), F.lit(0.0))) == 100.0 and one(spark, reconcile.candidate_score(F.lit(0.5), F.lit(False), F.lit(None).cast("boolean"), F.lit(None).cast("double"))) == 20.0
    a, b = make([(1, "http://x/1", "p")], "k int, u string, v string"), make([("http://y/z/1", "q"), ("http://y/2", "r")], "u2 string, w string")
    assert [r["w"] for r in reconcile.suffix_join(a, b, "u", "u2").collect()] == ["q"]
    places = make([(f"{w} {i}", 1.0, 2.0) for i, w in enumerate("abcde")] + [("x y", 3.0, 4.0)], "label string, lat double, lon double")
    assert [tuple(r) for r in reconcile.suspicious_repeats(places, "label", "lat", "lon").collect()] == [(1.0, 2.0, 5, 5)]
    grouped = reconcile.clusters(make([(i, [float(i // 10 * 50 + i % 10), 1.0]) for i in range(30)], "id int, e array<double>"), "e", 3).collect()
    assert len({r["cluster"] for r in grouped}) == 3 and len({r["cluster"] for r in grouped if r["id"] < 10}) == 1


def test_neighbourhoods_texts_and_shares(spark):
    make = spark.createDataFrame
    v = make([(i, [1.0, float(i)]) for i in range(8)] + [(9, None)], "id int, e array<double>")
    near = {r["id"]: r["n_seeds"] for r in vector.neighbourhood(v, [1.0, 0.0], "id", "e", 2, 2).collect()}
    assert near == {1: 1, 2: 2, 3: 1}  # angles 0, 45, 63, 72 degrees: 0 is near to 1 and 2, 1 to 2 and 3
    row = make([("Mill", ["a", "b"], "", None)], "t string, s array<string>, d string, n string").select(vector.composite_text(["t", "s", "d", "n"]).alias("x"), vector.composite_text(["s", "t"], ["s"]).alias("y")).first()
    assert tuple(row) == ("Mill. a, b", "Mill. a, b")
    edges = make([(1, "x"), (2, "x"), (3, "x"), (1, "y")], "k int, t string")
    assert [tuple(r) for r in vector.without_frequent(edges, "k", "t", 2).collect()] == [(1, ["y"])]
    assert [tuple(r) for r in aggregates.shared_prefixes(make([(f"Album ({i})",) for i in range(3)] + [("Other (1)",)], "t string"), "t").collect()] == [("Album", 3)]
    assert [tuple(r) for r in aggregates.covered(edges, "t", "k", F.col("k") > 1).orderBy("t").collect()] == [("x", 3, 2, 0.6667), ("y", 1, 0, 0.0)]


@pytest.mark.parametrize(("text", "phrase"), [("by Antonín Dvořák, 1880", "Dvořák"), ("by Antonin Dvorak", "dvořák"), ("Škoda works", "skoda"), ("Skǒda", "Škŏda"), ("Søren Łoś", "soren"), ("café au lait", "CAFÉ"), ("Nguyễn Ái", "nguyen ai")])
def test_texts_and_phrases_fold_alike(spark, text, phrase):
    row = spark.createDataFrame([(text,)], "t string").select(T.has_phrase(T.padded(T.tokens(F.col("t"))), phrase).alias("x")).first()
    assert row["x"] == (phrase.lower() != "škŏda" or T.words_of(phrase) == ["skoda"])


@pytest.mark.parametrize(("text", "pieces"), [
    ("sale A (b; (1700-1780) c); to D", ["sale A (b; (1700-1780) c)", " to D"]),
    ('a "x; y" b; c', ['a "x; y" b', " c"]), ("a; b; c", ["a", " b", " c"]), ("a (b; c", ["a (b", " c"]), ("a [b; (c; d); e]; f", ["a [b; (c; d); e]", " f"]), ("", [""]),
])
def test_pieces_outside_nested_brackets(spark, text, pieces):
    from vitrine.operators.provenance import outside_brackets

    assert spark.createDataFrame([(text,)], "t string").select(outside_brackets(F.col("t")).alias("p")).first()["p"] == pieces
