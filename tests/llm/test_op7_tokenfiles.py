import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.corpus import SCHEMA, no_documents, odd_documents, prose
from vitrine.llm import tokenfiles
from vitrine.llm.shared import open_store
from vitrine.llm.tokens import default_path, ids_of


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 3000), key=st.text(max_size=8))
def test_slots_are_a_permutation(n, key):
    slots = tokenfiles.Permutation(n, key).slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (tokenfiles.Permutation(n, key).slots(np.arange(n)) == slots).all()


def test_keys_give_other_orders():
    a, b = (tokenfiles.Permutation(5000, k).slots(np.arange(5000)) for k in ("x", "y"))
    assert (a == b).mean() < 0.01 and abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.1


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    rng = random.Random(3)
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    rows = [(i, prose(rng, rng.choice([1, 20, 300])), "en", "s", 0) for i in range(400)] + [(900, None, None, None, None), (901, "", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(5, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def streams(docs):
    """The ids of every partition, in order."""
    parts = docs.select("text").rdd.mapPartitions(lambda rows: [[r["text"] for r in rows]]).collect()
    return [np.concatenate([ids_of(t, default_path()) for t in p]) for p in parts if p]


def test_round_trip(spark, documents):
    manifest = tokenfiles.write(documents, key="k", length=128, shard_bytes=20_000)
    rows = sorted(tokenfiles.read(spark, manifest).collect(), key=lambda r: r["number"])
    want = [s[i : i + 128] for s in streams(documents) for i in range(0, len(s), 128)]
    assert [np.frombuffer(r["ids"], "<u2").tolist() for r in rows] == [w.tolist() for w in want]
    slots = tokenfiles.Permutation(len(rows), "k").slots(np.arange(len(rows)))
    assert [r["slot"] for r in rows] == slots.tolist()
    assert manifest.count() > 3


def test_files_have_a_fixed_stride(spark, documents):
    manifest = tokenfiles.write(documents, key="k", length=128, shard_bytes=20_000).orderBy("shard").collect()
    by_slot = {r["slot"]: r for r in tokenfiles.read(spark, tokenfiles.write(documents, key="k", length=128, shard_bytes=20_000)).collect()}
    first = 0
    for m in manifest:
        store, path = open_store(m["path"])
        with store.open_input_file(path) as f:
            raw = f.read()
        assert m["first_slot"] == first and len(raw) == m["sequences"] * m["stride"]
        for i in range(m["sequences"]):
            ids = by_slot[first + i]["ids"]
            assert raw[i * m["stride"] + tokenfiles.HEADER :][: len(ids)] == ids
        first += m["sequences"]
    assert first == len(by_slot)


def test_reading_resumes_at_any_slot(spark, documents):
    manifest = tokenfiles.write(documents, key="k", length=128, shard_bytes=20_000)
    every = {r["slot"]: r["ids"] for r in tokenfiles.read(spark, manifest).collect()}
    for at in (0, 1, 77, len(every) - 1, len(every), len(every) + 5):
        assert {r["slot"]: r["ids"] for r in tokenfiles.read(spark, manifest, at).collect()} == {s: x for s, x in every.items() if s >= at}


def test_odd_rows_and_empty_table(spark, tmp_path):
    path = str(tmp_path / "odd.parquet")
    odd_documents(spark).write.parquet(path)
    docs = spark.read.parquet(path)
    rows = tokenfiles.read(spark, tokenfiles.write(docs, length=64)).collect()
    assert sum(r["n_ids"] for r in rows) == sum(len(s) for s in streams(docs))
    assert tokenfiles.read(spark, tokenfiles.write(no_documents(spark))).count() == 0
