"""Operations on ownership histories: one test chain for each kind, what is not applied and why, odd rows."""

import hashlib

import pytest

from vitrine.operators import provenance, replay

OPS = "work string, op_id long, content_hash string, dup_ordinal int, dup_count int, op string, field string, value string, expected string, parties array<struct<name:string,dates:string,uncertain:boolean,role:string,position:string>>, target int, parts array<string>, confidence double"
TEXTS = {
    "a": "sold to Anna Berg, Amsterdam, 1800; gift of Carel Dorn, Paris, 1850; sold to Anna Berg, Amsterdam, 1800",
    "b": "collection Ewout Faber, Delft, 1700; on display, Delft; by descent to Gijs Faber, 1790",
    "c": "sold to Hugo Ising, London, 1810",
}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op(work, n, text, kind, copy=1, copies=1, confidence=0.9, **more):
    row = {"work": work, "op_id": n, "content_hash": digest(text), "dup_ordinal": copy, "dup_count": copies, "op": kind, "confidence": confidence}
    row |= {c: None for c in ("field", "value", "expected", "parties", "target", "parts")} | more
    return tuple(row[c] for c in ("work", "op_id", "content_hash", "dup_ordinal", "dup_count", "op", "field", "value", "expected", "parties", "target", "parts", "confidence"))


def person(name, role="buyer"):
    return {"name": name, "dates": None, "uncertain": False, "role": role, "position": provenance.POSITION.get(role)}


@pytest.fixture(scope="module")
def chain(spark):
    return provenance.events(spark.createDataFrame([*TEXTS.items()], "work string, history string"), "work", "history").cache()


def run(spark, chain, ops, **more):
    events, report = replay.replayed(chain, spark.createDataFrame(ops, OPS), "work", **more)
    by = {}
    for r in events.orderBy("work", "sequence").collect():
        by.setdefault(r["work"], []).append(r)
    return by, {(r["op"], r["status"]): r["n"] for r in report.collect()}


SALE, GIFT, OWN, SHOWN, HEIR, ONE = "sold to Anna Berg, Amsterdam, 1800", "gift of Carel Dorn, Paris, 1850", "collection Ewout Faber, Delft, 1700", "on display, Delft", "by descent to Gijs Faber, 1790", "sold to Hugo Ising, London, 1810"


def test_values_parties_and_corrections(spark, chain):
    ops = [
        op("a", 2, SALE, "set", 2, 2, field="transfer_type", value="exchange"), op("a", 1, SALE, "set", 2, 2, field="transfer_type", value="loan"), op("a", 3, GIFT, "set", field="date_year", value="1851"),
        op("a", 4, GIFT, "correct", field="location", value="Lyon", expected="Paris"), op("a", 5, SALE, "correct", 1, 2, field="location", value="Gent", expected="Brugge"),
        op("b", 6, OWN, "parties", parties=[person("Ewout F.", "collector")]), op("b", 7, OWN, "receiver", parties=[person("Second")]), op("b", 8, OWN, "receiver", parties=[person("Third")]),
        op("c", 9, ONE, "correct", field="date_year", value=None, expected="1811"), op("c", 10, ONE, "correct", field="date_year", value="1812", expected="1810"),
    ]
    by, report = run(spark, chain, ops)
    assert [(r["transfer_type"], r["transfer_category"], r["location"], r["date_year"]) for r in by["a"]] == [("sale", "ownership", "Amsterdam", 1800), ("gift", "ownership", "Lyon", 1851), ("exchange", "ownership", "Amsterdam", 1800)]
    assert [p["name"] for p in by["b"][0]["parties"]] == ["Ewout F.", "Second", "Third"] and by["c"][0]["date_year"] == 1812
    assert report == {("set", "applied"): 3, ("correct", "applied"): 2, ("correct", "value_changed"): 2, ("parties", "applied"): 1, ("receiver", "applied"): 2}


def test_marks_merges_and_splits(spark, chain):
    ops = [
        op("b", 1, SHOWN, "merge", target=1, value="The Hague"), op("b", 2, HEIR, "split", parts=["by descent to Gijs", "by descent to Mina"]), op("b", 3, SHOWN, "split", parts=["x", "y"]),
        op("a", 4, GIFT, "alternative", target=1), op("a", 5, SALE, "split", 2, 2, parts=["m", "n"]), op("c", 6, ONE, "mark"), op("c", 7, ONE, "split", parts=[]),
    ]
    by, report = run(spark, chain, ops)
    assert [(r["sequence"], r["raw_text"], r["location"]) for r in by["b"]] == [(1, OWN, "The Hague"), (2, "by descent to Gijs", None), (3, "by descent to Mina", None)]
    assert [(r["sequence"], r["raw_text"], r["uncertain"]) for r in by["a"]] == [(1, SALE, True), (2, "m", False), (3, "n", False)]
    assert [(r["transfer_type"], r["transfer_category"], r["raw_text"]) for r in by["c"]] == [("non_provenance", None, ONE)]
    assert report == {("merge", "applied"): 1, ("split", "applied"): 3, ("split", "text_changed"): 1, ("alternative", "applied"): 1, ("mark", "applied"): 1}


def test_what_is_not_applied(spark, chain):
    ops = [op("a", 1, "other", "mark"), op("a", 2, SALE, "mark", 1, 3), op("a", 3, SALE, "mark", 3, 2), op("a", 4, GIFT, "mark", confidence=0.6), op("a", 5, GIFT, "mark", confidence=None), op("a", 6, GIFT, "mark"), op("a", 7, GIFT, "turn"), op(None, 8, GIFT, "mark"), op("a", 9, GIFT, "mark", 1, None), op("a", None, GIFT, None)]
    by, report = run(spark, chain, ops, reverted=spark.createDataFrame([(6,), (6,), (None,)], "op_id long"))
    assert [r["transfer_type"] for r in by["a"]] == ["sale", "gift", "sale"]
    assert report == {("mark", "text_changed"): 2, ("mark", "copies_changed"): 2, ("mark", "no_such_copy"): 1, ("mark", "unsure"): 2, ("mark", "reverted"): 1, ("turn", "unknown"): 1, (None, "unknown"): 1}


def test_nothing_to_do_and_empty_chains(spark, chain):
    by, report = run(spark, chain, [])
    assert [r["raw_text"] for r in by["b"]] == [OWN, SHOWN, HEIR] and report == {}
    assert run(spark, chain.limit(0), [op("a", 1, SALE, "mark", 1, 2)]) == ({}, {("mark", "text_changed"): 1})
