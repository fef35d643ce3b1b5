"""References of one history to another: what is one, and where they lead."""

import random

from pyspark.sql import functions as F

from vitrine.operators import hierarchy, provenance, references

SAID = {
    "see SK-A-1": "SK-A-1", "Zie BK 1955-3.": "BK-1955-3", "See also the provenance of inv. no. RP-P-12a": "RP-P-12a", "zie onder SK C 5": "SK-C-5", "See under cat. no. SK-A-7.2": "SK-A-7.2",
    "* For the provenance see SK-A-9": "SK-A-9", "voor de herkomst zie SK-A-9": "SK-A-9", "Same provenance as SK-A-3": "SK-A-3", "dezelfde herkomst als de SK-A-3": "SK-A-3",
    "For both the present painting and its pendant SK-A-11, sale Paris": "SK-A-11", "together with the companion to SK-A-12": "SK-A-12", "lot A-4, sold; see SK-A-5": "SK-A-5", "<i>see</i> SK-A-6; see SK-A-8": "SK-A-6",
    "sold with its pendant SK-A-11": None, "sold to J. See, lot SK-A-1": None, "as SK-A-1": None, "see there": None, "": None, None: None, "SK-A-1": None, "seen SK-A-1": None,
}


def test_three_forms(spark):
    rows = spark.createDataFrame([(t,) for t in SAID], "t string").select("t", references.target(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == SAID


def test_lines_cycles_and_missing_works(spark):
    works = [("SK-A-1", "sold to Anna Berg, 1800; gift of Carel Dorn, 1850"), ("SK-A-2", "see sk-a-1 and SK A 1"), ("SK-A-3", "see SK-A-2"), ("SK-A-4", "see SK-A-5"), ("SK-A-5", "see SK-A-4"), ("SK-A-6", "see SK-A-4"), ("SK-A-7", "see SK-A-7"), ("SK-A-8", "see SK-A-99"),
             ("SK-A-9", None), ("SK-A-9", "see SK-A-1"), ("SK-A-10", "see SK-A-9"), (None, "see SK-A-1"), (None, None), ("SK-A-3", "see SK-A-2")]
    table = spark.createDataFrame(works, "number string, history string")
    found = references.resolved(table, "number", "history")
    got = sorted(((r["number"] or "", r["source"], r["hops"], r["status"]) for r in found.collect()), key=str)
    assert got == sorted([("SK-A-1", "SKA1", 0, "own"), ("SK-A-2", "SKA1", 1, "resolved"), ("SK-A-3", "SKA1", 2, "resolved"), ("SK-A-3", "SKA1", 2, "resolved"), ("SK-A-4", None, None, "cycle"), ("SK-A-5", None, None, "cycle"), ("SK-A-6", None, None, "cycle"), ("SK-A-7", None, None, "cycle"),
                          ("SK-A-8", "SKA99", 1, "missing"), ("SK-A-9", "SKA9", 0, "own"), ("SK-A-9", "SKA1", 1, "resolved"), ("SK-A-10", "SKA9", 1, "resolved"), ("", "SKA1", 1, "resolved"), ("", None, 0, "own")], key=str)
    events = provenance.events(table.where("number = 'SK-A-1'"), "number", "history")
    shared = references.lent(events, "number", found, "number").groupBy("number", "source").count().collect()
    assert {(r["number"], r["source"], r["count"]) for r in shared} == {("SK-A-1", "SKA1", 2), ("SK-A-2", "SKA1", 2), ("SK-A-3", "SKA1", 2), ("SK-A-9", "SKA1", 2), (None, "SKA1", 2)}


def test_no_works(spark):
    assert references.resolved(spark.createDataFrame([], "number string, history string"), "number", "history").count() == 0


def test_words_of_a_text_are_found_once(spark):
    """Not again for every word, which takes the square of a history's length."""
    plan = spark.range(1).select(references.target(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_cycles_end_in_few_rounds(spark, monkeypatch):
    """Works in cycles were followed until the disk was full."""
    r = random.Random(2)
    ups = {n: n - 1 for n in range(2, 130)} | {n: n + 1 for n in range(200, 260)} | {260: 200} | {n: r.randrange(300, 400) for n in range(300, 398, 2)} | {n: r.choice([1, 60, 129, 210, 399, 5000]) for n in range(400, 420)} | {500: 500, 501: 500}
    works = sorted({1, 60, 129, 399, *ups, *range(300, 400)})

    def walked(n):
        hops, at = 0, n
        while at in ups and hops <= len(works):
            hops, at = hops + 1, ups[at]
        return (None, None, "cycle") if hops > len(works) else (f"A{at}", hops, "own" if not hops else "resolved" if at in works else "missing")

    calls = []

    def few(df, kept=hierarchy.kept):
        calls.append(1)
        assert len(calls) < 12
        return kept(df)

    for module in (hierarchy, references):
        monkeypatch.setattr(module, "kept", few)
    table = spark.createDataFrame([(f"A-{n}", f"see A-{ups[n]}" if n in ups else "sold to Anna Berg, 1800") for n in works], "number string, history string")
    got = {int(x["number"][2:]): (x["source"], x["hops"], x["status"]) for x in references.resolved(table, "number", "history").collect()}
    assert got == {n: walked(n) for n in works}
