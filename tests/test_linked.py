"""Linked-data objects: one document with every shape, odd documents, and each table of it."""

import json

import pytest

from vitrine.functions.scalar import authority_of
from vitrine.sources import linked

A, L = linked.GETTY, {k: [{"id": linked.GETTY + n}] for k, n in linked.LANGUAGES.items()}
DOC = {
    "identified_by": [
        {"type": "Name", "content": ["The", "Mill", 3], "language": L["en"], "classified_as": [A + "1", {"id": A + "300417207"}]}, {"type": "Name", "content": "De molen", "language": L["nl"]},
        {"type": "Name", "content": "Le moulin", "language": [{"id": "http://x/fr"}], "classified_as": "http://x/old"}, {"type": "Identifier", "content": "SK-1"}, {"type": "Name", "content": ""}, "text", None],
    "dimension": [
        {"value": "x", "classified_as": [{"id": A + "300055644"}]}, {"value": 305, "unit": {"id": A + "300379097"}, "classified_as": [{"id": A + "300055644"}], "referred_to_by": {"content": "sheet"}},
        {"value": "1.234", "unit": {"id": A + "300379100"}, "classified_as": {"id": A + "300055647"}}, {"value": 7.125, "classified_as": ["http://x/deep"], "referred_to_by": [{"content": ["a", "b"]}, "c"]}, {"value": 2, "unit": {"id": A + "300379226"}, "classified_as": [A + "300056240"]}],
    "referred_to_by": [
        {"classified_as": [{"id": A + "300435414"}], "content": "signed", "created_by": {"timespan": {"begin_of_the_begin": "2001-02-03", "end_of_the_end": "2002"}}}, {"classified_as": A + "300435414", "content": ["dated", "1650"], "created_by": {"timespan": {"begin_of_the_begin": "1999", "end_of_the_end": "2020"}}},
        {"classified_as": [{"id": A + "300026687"}], "content": "gift of Vos"}, {"content": "other"}],
    "produced_by": {
        "part": [
            {"technique": [{"id": "http://x/t1"}], "classified_as": {"id": "http://x/first"}, "took_place_at": {"id": "http://x/p1"}, "used_object_of_type": [A + "300033973"],
             "assigned_by": [{"type": "AttributeAssignment", "assigned_property": "carried_out_by", "assigned": [{"id": "http://x/vos"}, {"type": "Group", "formed_by": {"influenced_by": [{"id": "http://x/boer"}]}}], "classified_as": [{"id": "http://x/workshop"}],
                              "motivated_by": [{"classified_as": ["http://x/sign"], "carried_by": ["http://x/b1", {"id": "http://x/b2"}], "identified_by": [{"content": "getekend", "language": L["nl"]}, {"content": "signed", "language": L["en"]}]}, {"classified_as": []}]},
                             {"type": "Other", "assigned_property": "carried_out_by", "assigned": [{"id": "http://x/no"}]}]},
            {"technique": "http://x/t2"}],
        "took_place_at": [{"id": "http://x/p2"}], "technique": [{"id": "http://x/never"}]},
    "modified_by": {"carried_out_by": ["http://x/rest"], "timespan": {"identified_by": [{"type": "Name", "content": "ca. 1900"}], "begin_of_the_begin": "1899"}, "referred_to_by": [{"content": ""}, {"content": ["cleaned", "lined"]}]},
    "attributed_by": [
        {"carried_out_by": [{"id": "http://x/ann"}], "classified_as": [{"id": "http://x/r1", "notation": [{"@language": "nl", "@value": "rapport"}, {"@language": "en", "@value": "report"}]}], "timespan": {"end_of_the_end": "2001"}},
        {"carried_out_by": [{"id": "http://x/bo", "identified_by": [{"content": "Bo"}]}], "classified_as": [{"id": "http://x/r2", "identified_by": [{"content": "scan"}]}]}, {"carried_out_by": [{"id": "http://x/bo"}]},
        {"assigned": [{"id": "http://x/o2"}, {}], "identified_by": [{"content": "copy", "language": L["en"]}, {"content": "kopie", "language": L["nl"]}]}, {"assigned": [{"id": "http://x/o3"}], "identified_by": [{"content": "pendant"}]}, {"assigned": [{"id": "http://x/o4"}]}],
    "equivalent": ["http://www.wikidata.org/entity/Q5", {"id": "http://x/e"}, {"id": "http://x/e"}], "shown_by": [{"equivalent": {"id": "http://x/f"}}],
    "subject_of": [{"language": L["nl"], "part": [{"classified_as": [{"id": A + "300048722"}], "content": "een essay"}]}, {"language": L["en"], "part": [{"classified_as": [], "content": "no"}, {"classified_as": [{"id": A + "300048722"}], "content": "an essay"}]}],
    "part_of": [{"type": "HumanMadeObject", "id": "http://x/album"}, {"type": "Set", "id": "http://x/set"}], "about": ["http://x/a1", {"id": "http://x/a2"}], "shows": [{"id": "http://x/v1"}, {"id": "http://x/v2"}],
}


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(2, "{}"), (3, "[1]"), (4, "no json"), (5, None), (6, '{"identified_by": 5, "dimension": "x", "produced_by": [], "modified_by": null, "attributed_by": {"a": 1}, "subject_of": "s", "equivalent": 7, "part_of": 1}')]
    return linked.documents(spark.createDataFrame([(1, json.dumps(DOC)), *odd], "id int, json string"), "id", "json")


def rows(df):
    return sorted((tuple(r)[1:] for r in df.collect() if r["id"] == 1), key=str)


def test_documents(docs):
    assert sorted(r["id"] for r in docs.collect()) == [1, 2, 6]
    odd = docs.where("id <> 1")
    for table in (linked.titles, linked.statements, linked.production, linked.evidence, linked.treatments, linked.relations, linked.narratives, linked.links):
        assert table(odd, "id").count() == 0, table.__name__
    assert [tuple(r)[1:] for r in linked.dimensions(odd, "id").collect()] == [(None,) * 6] * 2
    assert linked.titles(docs.limit(0), "id").count() == 0


def test_titles_and_dimensions(docs):
    assert rows(linked.titles(docs, "id", {"former": "http://x/old"})) == [(0, "The Mill", "en", "brief"), (1, "De molen", "nl", None), (2, "Le moulin", "fr", "former")]
    assert rows(linked.dimensions(docs, "id", {"depth": ["http://x/deep"]})) == [(30.5, 123.4, 7.125, None, 2000.0, "sheet | a | b")]


def test_statements(docs):
    assert rows(linked.statements(docs, "id")) == [("credit_line", "gift of Vos"), ("inscription", "signed | dated | 1650")]
    assert rows(linked.edited(docs, "id")) == [("1999", "2020")]
    assert rows(linked.narratives(docs, "id")) == [("an essay",)]


def test_production(docs):
    assert rows(linked.production(docs, "id")) == sorted([
        (-1, "place", "p2", None), (0, "role", "t1", None), (0, "qualifier", "first", None), (0, "qualifier", "workshop", None), (0, "maker", "vos", None), (0, "maker", "boer", None), (0, "attribution", "workshop", "vos"),
        (0, "attribution", "workshop", "boer"), (0, "place", "p1", None), (0, "source_type", "300033973", None), (1, "role", "t2", None)], key=str)
    assert rows(linked.evidence(docs, "id")) == [(0, "http://x/sign", "http://x/b1", "signed"), (0, "http://x/sign", "http://x/b2", "signed"), (0, None, None, None)]


def test_events(docs):
    assert rows(linked.treatments(docs, "id")) == [(0, "http://x/rest", "ca. 1900", "1899", None, "cleaned lined")]
    assert rows(linked.examinations(docs, "id")) == [(0, "ann", "http://x/r1", "report", None, None, "2001"), (1, "Bo", "http://x/r2", "scan", None, None, None)]


def test_ids_and_links(docs):
    assert rows(linked.relations(docs, "id")) == [("http://x/o2", "copy", "kopie"), ("http://x/o3", "pendant", None)]
    found = linked.other_ids(docs, "id", lambda u: authority_of(u)["authority"])
    assert rows(found) == [("wikidata.org", "http://www.wikidata.org/entity/Q5"), ("x", "http://x/e"), ("x", "http://x/f")]
    assert rows(linked.links(docs, "id")) == [("about", "a1"), ("about", "a2"), ("part_of", "http://x/album"), ("shows", "http://x/v1")]
