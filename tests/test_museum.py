"""What searches of ownership refuse, places by their context, dimensions, and curation on small cases."""

import pytest

from vitrine import dimensions, ownership
from vitrine.catalogue import Catalogue, cleaned
from vitrine.operators import curation
from vitrine.plans.museum import catalogue
from vitrine.plans.registry import Tables


@pytest.mark.parametrize(("params", "layer"), [({}, "events"), ({"sortBy": "price"}, "events"), ({"ownerName": "Vos"}, "events"), ({"transferType": "sale"}, "periods"), ({"party": "Vos", "sortBy": "price"}, "periods"), ({"colour": "red"}, "events")])
def test_layers_refuse_what_they_lack(params, layer):
    with pytest.raises(ValueError):
        ownership.checked(params, layer)


def test_layers_share_filters():
    assert ownership.checked({"party": "Vos", "location": None}, "events") == ownership.checked({"party": "Vos"}, "periods")
    assert cleaned({"gender": "female", "unsold": "true"}) == {"gender": "female", "unsold": True}


def test_a_place_by_what_follows_the_comma(spark):
    """Of two places of one name the one near the other place; without it the first id; unknown names lose words."""
    rows = [("a", "place", "Zwolle", None, 52.5, 6.1), ("b", "place", "Zwolle", None, 31.0, -93.0), ("c", "place", "Overijssel", None, 52.4, 6.5), ("d", "place", "Texas", None, 31.5, -99.0)]
    c = Catalogue(vocabulary=spark.createDataFrame(rows, "id string, type string, label_en string, label_nl string, lat double, lon double"))
    assert [c.located(n)["id"] for n in ("Zwolle", "Zwolle, Overijssel", "Zwolle, Texas", "Zwolle Harbour")] == ["a", "a", "b", "a"]
    assert c.located("Nowhere") is None


def test_edges_are_never_broadcast(spark, sf_dir):
    """Fields that are constants leave no key to join by: the small side is the names of the fields."""
    plan = catalogue(Tables(spark, sf_dir)).edges("theme")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BuildLeft" not in plan


def test_dimensions():
    by_name = {d["name"]: d for d in dimensions.described()}
    assert by_name["century"] == {"name": "century", "multi_valued": False, "grouping_key": "computed_bucket", "default_ordering": "count_desc", "bucket_unit": "year", "bucket_width": 100, "bucket_min": None, "bucket_max_exclusive": None, "creator_domain": None}
    assert by_name["creatorBirthDecade"]["creator_domain"] == "person-row" and by_name["profession"]["creator_domain"] == "artwork-level" and by_name["exhibition"]["grouping_key"] == "entity"
    with pytest.raises(ValueError):
        dimensions.counted(None, "colour")


SAID = [
    ("Unsold at the sale, Paris", "sale"), ("commissioned by the city, 1640", "commission"), ("commissioned portraits", "unknown"), ("confiscation by the state", "confiscation"), ("sent to The Hague", "transfer"), ("sent for", "unknown"), ("his testamentary gift", "bequest"),
    ("sale, Amsterdam, 12 May 1802, lot 3", "sale"), ("sale [Hoet]", "sale"), ("sale, Paris", "unknown"), ("wholesale", "unknown"), ("their great-grandsons, 1850", "by_descent"), ("sons of Noah", "unknown"), ("from Baron Vos through others to P. de Boer", "sale"), ("to Baron Vos from here", "unknown"),
    ("the widower Vos", "widowhood"), ("from whom, with others, to the museum", "sale"), ("with an art dealer, Bonn", "collection"), ("collection Vos, by whom given by hand", "collection"), ("given by Vos", "gift"), ("stored in Haarlem", "deposit"), ("estate inventory Vos", "inventory"), ("inventory of 1650", "collection"),
]


def test_what_pieces_say(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(SAID, "x string, wanted string")
    assert [(r["x"], r["found"]) for r in rows.select("x", curation.transfer_of(F.col("x")).alias("found")).collect()] == SAID
    own = [("Jan Vos (1606-1669)", True), ("Jan Vos (L. 123)", True), ("Jan Vos", False), ("Galerie Vos", True), ("a private collector, Bonn", True), ("Counting", False), ("", False), (None, False)]
    rows = spark.createDataFrame(own, "x string, wanted boolean")
    assert [(r["x"], r["found"]) for r in rows.select("x", curation.collection_like(F.col("x")).alias("found")).collect()] == own
    pieces = [("lot 12", False), ("no. 3-5", False), ("(unpublished)", False), ("lot 12, Vos", True), ("Vos (1606)", True), ("1650", False)]
    rows = spark.createDataFrame(pieces, "x string, wanted boolean")
    assert [(r["x"], r["found"]) for r in rows.select("x", curation.is_piece(F.col("x")).alias("found")).collect()] == pieces


def test_nulls_empty_tables_and_ties(spark):
    rows = spark.createDataFrame([(1, None, "manual", 1), (1, "x", "inferred", 2), (1, "w", "inferred", 2), (2, "y", "guessed", 1)], "k int, v string, t string, at int")
    assert [tuple(r) for r in curation.promoted(rows, "k", "v", "t", ["at"]).collect()] == [(1, "w", "inferred")]
    assert curation.promoted(rows.limit(0), "k", "v", "t", ["at"]).count() == 0
    text = spark.createDataFrame([(None,), ("",), ("Sale, Paris",), ("Führermuseum",)], "x string")
    from pyspark.sql import functions as F

    assert [r[0] for r in text.select(curation.transfer_of(F.col("x"))).collect()] == ["unknown", "unknown", "unknown", "confiscation"]
    out, codes = curation.coded(spark.createDataFrame([(1, "b"), (2, None), (3, ""), (4, "a"), (5, "b")], "i int, r string"), "r", "r_id")
    assert sorted((r["i"], r["r_id"]) for r in out.collect()) == [(1, 2), (2, None), (3, None), (4, 1), (5, 2)]
    assert sorted(tuple(r) for r in codes.collect()) == [(1, "a"), (2, "b")]
    assert curation.sampled(rows, "k", 10).count() == 4 and curation.sampled(rows, "k", 2).collect() == curation.sampled(rows.orderBy("v"), "k", 2).collect()
