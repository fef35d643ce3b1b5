import hashlib
import random
import re

import pytest

from tests.llm.corpus import SCHEMA, no_documents, odd_documents, prose
from vitrine.llm import substrings


def brute(rows, window):
    """(id, n_words, n_removed, kept text) of each row, from the places of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    places = {}
    for i, w in enumerate(words):
        for s in range(len(w) - window + 1):
            places.setdefault(tuple(w[s : s + window]), []).append((i, s))
    gone = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for i, s in found:
                gone[i].update(range(s, s + window))
    return [(rows[i][0], len(w), len(gone[i]), " ".join(x for n, x in enumerate(w) if n not in gone[i])) for i, w in enumerate(words)]


def compared(spark, rows, window=35, seed=12):
    rows = list(rows.items()) if isinstance(rows, dict) else rows
    made = substrings.remove_repeats(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3), window, seed).collect()
    found = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in made]

    def order(row):
        return row[0] is None, row[0] or 0, row[1:]

    assert sorted(found, key=order) == sorted(brute(rows, window), key=order)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in made:  # every factor's words are those of the place that it copies from
        for f in r["factors"]:
            here = {tuple(w[f["start"] : f["start"] + f["length"]]) for w in by_id[r["doc_id"]]}
            there = {tuple(w[f["ref_start"] : f["ref_start"] + f["length"]]) for w in by_id[f["ref_id"]]}
            assert max(map(len, here & there)) == f["length"] >= window
    return {r[0]: r[1:] for r in found}


def planted(rng):
    """Documents with shared passages around the window's length, whole copies, and repeats of their own."""
    shared = [prose(rng, n) for n in (20, 34, 35, 36, 50, 80, 200)]
    texts = {}
    for i in range(80):
        parts = [prose(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(0, 30))]
        texts[i] = rng.choice([" ", "\n", "  "]).join(p for p in parts if p)
    texts |= {100: texts[3], 101: texts[3], 102: "echo " * 200, 103: "a b " * 60, 104: None, 105: "", 106: prose(rng, 34), 107: prose(rng, 35)}
    return texts


@pytest.mark.parametrize("number", [1, 2, 3])
def test_against_all_windows(spark, number):
    found = compared(spark, planted(random.Random(number)))
    assert found[100] == (found[100][0], found[100][0], "") and found[102][2] == ""


def test_other_windows(spark):
    texts = planted(random.Random(9))
    compared(spark, texts, window=10, seed=4)
    compared(spark, texts, window=3, seed=2)


def test_few_words_that_repeat_everywhere(spark):
    rng = random.Random(4)
    compared(spark, {i: " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))) for i in range(60)}, window=12, seed=5)


def test_a_task_that_forgets_blocks_still_finds_all(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HELD", 3)
    compared(spark, planted(random.Random(11)))


def test_ids_that_repeat_or_are_null(spark):
    """Rows are rows: the unique text of an id stays, whatever other rows of that id lose."""
    rng = random.Random(5)
    w, u, v = prose(rng, 60), prose(rng, 60), prose(rng, 70)
    compared(spark, [(1, w), (1, u), (2, w), (None, v), (None, v), (None, prose(rng, 50)), (3, v + " " + prose(rng, 40)), (4, u[: len(u) // 2]), (5, u), (5, u)])


@pytest.mark.parametrize("hot", [1, 3])
def test_very_common_seeds_go_by_window(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    compared(spark, planted(random.Random(12)))
    rng = random.Random(13)
    line = prose(rng, 20)  # shorter than a window: its windows differ in every text
    compared(spark, {i: f"{prose(rng, 30)} {line} {prose(rng, 30)}" for i in range(40)} | {90: f"{line} " * 4})


def test_odd_rows_and_empty_table(spark):
    rows = substrings.remove_repeats(odd_documents(spark)).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert (by[None]["n_words"], by[None]["n_removed"]) == (3, 0)
    assert [by[i]["n_words"] for i in (1, 2, 3)] == [0, 0, 0] and by[1]["kept_text"] == ""
    assert (by[6]["n_words"], by[6]["n_removed"]) == (20000, 20000)
    assert substrings.remove_repeats(no_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(no_documents(spark), window=10, seed=11)


def test_query_digest(spark, sf_dir):
    from vitrine.llm.queries import op4_substrings

    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(texts, 35)}
    rows = op4_substrings(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == want
