import random
import re

import pytest

import corpus_pipeline
from tests.llm.corpus import SCHEMA, odd_documents, prose
from tests.llm.test_op1_decontamination import brute as brute_contained
from tests.llm.test_op3_simhash import brute_similar

ENGLISH = "the of and that with from which this have were their there would about other people river water house night morning because through".split()


def english(rng, n):
    return " ".join(rng.choice(ENGLISH) + rng.choice(["", "", "ing", "er", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted cases, and their benchmark."""
    rng = random.Random(21)
    path = str(tmp_path_factory.mktemp("sf"))
    items = [(i, english(rng, 25)) for i in range(5)]
    texts = {i: english(rng, rng.randrange(30, 200)) for i in range(80)}
    texts |= {100 + i: texts[i] for i in range(10)}  # exact copies
    for i in range(10, 20):
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        texts[100 + i] = " ".join(words)
    texts |= {200 + i: f"{english(rng, 60)} {items[i][1].upper()} {english(rng, 60)}" for i in range(5)}
    texts |= {300: "12345 678 !!! ???", 301: "", 302: None, 303: "汉字 文章 没有 别的 语言 " * 10, 304: "▒▒▒ ▓▓▓"}
    texts |= {400: english(rng, 40) + " mail jo.doe@mail.example.com or +1 (663) 555-6869", 401: english(rng, 40) + " mail jo.doe@mail.example.com"}
    rows = [(i, t, "en" if i < 300 or i >= 400 else None, "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What every stage gives, each fed with its predecessor's rows."""
    path = folder[0]
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        to = f"{path}/out-{name}"
        stage(spark, docs, path).write.parquet(to)
        docs = out[name] = spark.read.parquet(to)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_unknown_languages_go_and_known_ones_stay(folder, stages):
    assert ids(stages["language_id"]) == set(folder[1]) - {300, 301, 302, 303, 304}


def test_one_of_each_group_stays(stages):
    before = texts_of(stages["language_id"])
    groups = brute_similar(before, 5, 0.8)
    assert ids(stages["near_duplicates"]) == {i for i, r in groups.items() if r == i}
    assert not ids(stages["near_duplicates"]) & set(range(100, 110))


def test_documents_with_items_go(folder, stages):
    before = texts_of(stages["near_duplicates"])
    found = {d for d, _ in brute_contained(list(before.items()), folder[2])}
    assert found == {200, 201, 202, 203, 204}
    assert ids(stages["decontamination"]) == set(before) - found


def test_personal_data_is_replaced_and_clean_texts_stay(stages):
    before, rows = texts_of(stages["decontamination"]), stages["personal_data"].collect()
    after = {r["doc_id"]: r["text"] for r in rows}
    assert set(after) == set(before)
    assert {i for i in after if after[i] != before[i]} == {400, 401}
    assert "jo.doe" not in after[400] and "555-6869" not in after[400]
    mail = [re.search(r"\S+@\S+", after[i])[0] for i in (400, 401)]
    assert mail[0] == mail[1]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_all_that_is_left_is_packed(stages):
    from vitrine.llm.tokens import default_path, ids_of

    got = {}
    for r in stages["packing"].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: len(ids_of(t, default_path())) for i, t in texts_of(stages["personal_data"]).items()}


def test_run_gives_the_last_stage(spark, folder, stages):
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder[0]).select(key).collect())) == sorted(map(tuple, stages["packing"].select(key).collect()))


def test_stages_take_odd_rows(spark, folder):
    for name, stage in corpus_pipeline.STAGES:
        docs = odd_documents(spark, clash=False)
        assert stage(spark, docs, folder[0]).count() >= 0, name
        assert stage(spark, docs.limit(0), folder[0]).count() == 0, name


def test_near_copies_are_met_by_fingerprints(spark, monkeypatch):
    """The stage found candidates by shingles only, without the index of operator 3."""
    from vitrine.llm import simhash

    rng = random.Random(8)
    words = english(rng, 400).split()
    texts = [" ".join(words), " ".join(words[:-1]), " ".join([*words, "through"]), english(rng, 400), None, " "]
    real = simhash.candidates

    def without_shingles(*args):
        pairs, long = real(*args)
        return pairs.limit(0), long.limit(0)

    monkeypatch.setattr(simhash, "candidates", without_shingles)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert ids(corpus_pipeline.one_of_each_group(spark, docs, "")) == {0, 3, 4}  # null and blank are alike
