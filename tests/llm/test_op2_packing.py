import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.corpus import SCHEMA, no_documents, odd_documents, prose
from vitrine.llm import packing
from vitrine.llm.tokens import default_path, ids_of


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_ids_are_those_of_the_json_vocabulary(reference, text):
    assert ids_of(text, default_path()).tolist() == reference(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|> b", " \n\n  x  \t ", "don't WE'LL", "\u0085 x", "x" * 5000, "é" * 50, "१२३ ４５"])
def test_ids_of_odd_texts(reference, text):
    assert ids_of(text, default_path()).tolist() == reference(text)


@pytest.mark.parametrize("run", [" ", "\n", "x", "word ", "é"])
def test_very_long_runs(spark, reference, run):
    """Three million characters without a place to split at."""
    rows = packing.pack(spark.createDataFrame([(1, run * (3_000_000 // len(run)), "en", "s", 0)], SCHEMA), 2048).collect()
    assert sum(r["length"] for r in rows) == rows[0]["doc_tokens"] == len(reference(run * (3_000_000 // len(run))))


def checked(rows, texts, reference, capacity):
    """Every id of every document in one piece, sequences gapless and within capacity."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, text in texts.items():
        ids, at = reference(text), 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            piece = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    assert set(by_sequence) == set(range(len(by_sequence)))
    return sum(r["length"] for r in rows) / (capacity * len(by_sequence))


def test_pieces_hold_every_id_with_little_padding(spark, reference):
    rng = random.Random(1)
    texts = {i: prose(rng, rng.choice([1, 3, 20, 60, 200, 900])) for i in range(300)}
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], SCHEMA)
    for capacity in (64, 2048):
        share = checked(packing.pack(docs, capacity).collect(), texts, reference, capacity)
        assert share > 0.98


def test_odd_rows_and_empty_table(spark, reference):
    rows = packing.pack(odd_documents(spark), 64).collect()
    texts = {1: None, 2: "", 3: " \t\n "}
    checked(rows, texts, reference, 64)
    assert {r["doc_id"] for r in rows} == {None, *range(1, 8)}
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 2 * len(reference("word"))  # repeated rows both count
    assert packing.pack(no_documents(spark), 64).count() == 0


@settings(max_examples=60, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 24), st.integers(1, 30), min_size=1), capacity=st.integers(24, 40))
def test_a_plan_uses_every_length_and_fits(counts, capacity):
    used = {}
    for times, pattern in packing.plan(counts, capacity):
        assert sum(length * n for length, n in pattern) <= capacity
        for length, n in pattern:
            used[length] = used.get(length, 0) + times * n
    assert used == counts


@settings(max_examples=60, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), gap=st.integers(0, 30))
def test_fill_is_the_subset_sum_closest_to_the_gap(counts, gap):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    pattern = packing.fill(gap, dict(counts))
    assert all(0 < n <= counts[length] for length, n in pattern)
    assert sum(length * n for length, n in pattern) == max(s for s in sums if s <= gap)


def test_vector_ids_come_along(spark):
    docs = spark.createDataFrame([(1, "alder birch", "en", "s", 0)], SCHEMA)
    row = packing.pack(docs, 64, with_ids=True).first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == ids_of("alder birch", default_path()).tolist()
