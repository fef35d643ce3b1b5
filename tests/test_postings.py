"""Stored postings give the scores of a pass over all texts, and read the query's words alone."""

import math
import re

import pytest

from vitrine.operators import postings, text

DOCS = [(1, "The red house by the river", "brick"), (2, "A RÉD river, a red river", None), (3, "no match here", "red river"), (3, "river red", "red"), (None, "red", "red red red"), (5, None, None), (6, "", "…"), (7, "house of the red river house", "the river")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "id long, title string, note string").selectExpr("id", "title", "note", "1 as term", "2 as row", "3 as len")
    folder = str(tmp_path_factory.mktemp("postings"))
    postings.build(docs, "id", ["title", "note"], folder, buckets=4)
    return docs, folder


@pytest.mark.parametrize(("phrases", "fields"), [(["red"], None), (["red river"], None), (["red", "the river", "house"], None), (["red river", "absent"], ["title"]), (["river"], ["note"]), (["absent"], None), (["", "Réd"], None), (["…"], None)])
def test_scores_are_those_of_all_texts(spark, stored, phrases, fields):
    docs, folder = stored
    rows = lambda df: sorted((r["id"] or 0, round(r["score"], 9)) for r in df.collect())
    assert rows(postings.bm25(spark, folder, "id", phrases, fields)) == rows(text.bm25(docs, "id", ["title", "note"], phrases, fields))


def test_only_buckets_and_terms_of_the_query_are_read(spark, stored):
    plan = postings.of_words(spark, stored[1], ["red", "river"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "In(term, [red,river])" in plan and "pmod" not in plan


def test_a_phrase_that_overlaps_itself_counts_at_each_place(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ha ha ha"), (2, "x"), (3, "y"), (4, "z")], "id long, t string")
    postings.build(docs, "id", ["t"], str(tmp_path))
    score = postings.bm25(spark, str(tmp_path), "id", ["ha ha"]).first()["score"]
    assert score == pytest.approx(-math.log(3.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 1.5)))


def test_an_empty_table(spark, tmp_path):
    postings.build(spark.createDataFrame([], "id long, t string"), "id", ["t"], str(tmp_path))
    assert postings.bm25(spark, str(tmp_path), "id", ["red"]).count() == 0


def test_postings_are_made_without_a_shuffle(spark, stored):
    """Only writing them by term shuffles; places come from the document's own row, for long texts too."""
    docs, _ = stored
    made = postings.postings(postings.lengths(docs, "id", ["title", "note"]), ["title", "note"])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    long = spark.createDataFrame([(1, "b a " * 30_000 + "c")], "id long, t string")
    rows = postings.postings(postings.lengths(long, "id", ["t"]), ["t"]).collect()
    assert {r["term"]: r["places"] for r in rows} == {"b": [*range(0, 60_000, 2)], "a": [*range(1, 60_000, 2)], "c": [60_000]}
    assert {(r["field"], r["key"], r["len"]) for r in rows} == {("t", 1, 60_001)}
