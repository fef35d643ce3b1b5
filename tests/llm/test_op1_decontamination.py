import random
import re

import pytest

from tests.llm.corpus import SCHEMA, no_documents, odd_documents, prose
from vitrine.llm import decontaminate


def shingles(text, k):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(docs, items, threshold=0.8, k=5):
    out = {}
    for d, text in docs:
        for i, item in items:
            n = min(k, len([w for w in re.split(r"[^\w]+|_", (item or "").lower()) if w]))
            want, have = shingles(item, n or k), shingles(text, n or k)
            shared = len(want & have)
            if want and shared >= threshold * len(want) - 1e-9:
                out[d, i] = (len(want), shared)
    return out


def tables(spark, docs, items):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")


def planted(rng):
    items = [(i, prose(rng, rng.randrange(3, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "a b c"), (93, "one two three four five")]
    docs = []
    for d in range(120):
        body = prose(rng, rng.choice([10, 200, 1500]))
        if d % 3 == 0:
            words = rng.choice(items[:40])[1].split()
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = "swapped"
            body = f"{body}, {' '.join(words).upper()}! {prose(rng, 30)}"
        docs.append((d, body))
    return [*docs, (200, "One, two; THREE -- four five."), (201, None), (202, ""), (203, "so A, b c!"), (204, "a b"), (205, "b c a")], items


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_against_all_pairs(spark, threshold):
    docs, items = planted(random.Random(7))
    found = decontaminate.contained(*tables(spark, docs, items), threshold=threshold).collect()
    want = brute(docs, items, threshold)
    assert {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in found} == want
    assert len(found) == len(want) > 10


def test_both_ways_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL", -1)
    docs, items = planted(random.Random(8))
    found = decontaminate.contained(*tables(spark, docs, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == set(brute(docs, items))


def test_documents_with_items_go(spark):
    docs, items = planted(random.Random(9))
    d, i = tables(spark, docs, items)
    kept = decontaminate.without_items(d, i)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {x for x, _ in docs} - {x for x, _ in brute(docs, items)}


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "alder birch cedar drift ember alder"), (1, None), (None, "alder birch cedar drift ember"), (2, "")], "item_id long, text string")
    found = decontaminate.contained(odd_documents(spark), items).collect()
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in found] == [(6, 1, 1.0)]
    assert {r["doc_id"] for r in decontaminate.without_items(odd_documents(spark), items).collect()} == {None, 1, 2, 3, 4, 5, 7}
    assert decontaminate.contained(no_documents(spark), items).count() == 0
    assert decontaminate.contained(odd_documents(spark), items.limit(0)).count() == 0
    assert decontaminate.without_items(odd_documents(spark), items.limit(0)).count() == 9


def test_the_plan_has_no_python_and_no_cartesian_product(spark):
    docs, items = tables(spark, *planted(random.Random(1)))
    plan = decontaminate.contained(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
