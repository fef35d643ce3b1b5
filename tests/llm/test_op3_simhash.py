import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.corpus import SCHEMA, no_documents, odd_documents, prose
from vitrine.llm import simhash
from vitrine.llm.shared import components


def brute_fingerprint(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, d):
    """Smallest reachable id for (id, fingerprint) rows, over all pairs."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(prints):
        for b, y in prints[n + 1 :]:
            if (x ^ y).bit_count() <= d and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i, _ in prints}


def test_fingerprints_components_against_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(150)]
    for t in texts[:40]:
        words = t.split()
        texts.append(t.upper())
        if len(words) > 50:
            words[rng.randrange(len(words))] = "changed"
            texts.append("  ".join(words))
    texts += [None, "", " ", "one", "ONE", texts[0]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs, 4, 4).collect()}
    prints = [(i, brute_fingerprint(t, 4)) for i, t in enumerate(texts)]
    want = brute_components(prints, 4)
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{x:016x}" for i, x in prints}
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert len(set(want.values())) < len(texts) - 20


@pytest.mark.parametrize("d", [1, 3, 4, 5, 7])
def test_no_link_is_missed(spark, d):
    rng = random.Random(d)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    values = set(seeds)
    for s in seeds:
        for flips in range(1, 9):
            values.add(s ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    classes = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(classes, d)).collect()}
    want = brute_components([(v, v % (1 << 64)) for v in signed], d)
    assert {v: roots.get(v, v) for v in signed} == want


def test_long_lists_are_dealt_out_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    base = 0x0123456789ABCDEF
    rng = random.Random(5)
    values = sorted({base ^ (1 << b) for b in range(63)} | {base ^ rng.getrandbits(40) for _ in range(200)})
    classes = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(classes, 4)).collect()}
    assert {v: roots.get(v, v) for v in values} == brute_components([(v, v) for v in values], 4)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)}


def test_odd_rows_and_empty_table(spark):
    rows = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["component_id"] is None and by[None]["fingerprint"] == f"{brute_fingerprint('alder birch cedar', 4):016x}"
    assert [by[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 1] and by[1]["fingerprint"] == "0" * 16
    assert [r["component_id"] for r in rows if r["doc_id"] == 4] == [4, 4]
    assert by[6]["fingerprint"] == f"{brute_fingerprint('alder birch cedar drift ember ' * 4000, 4):016x}"
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 4, 5, 6, 7]
    assert simhash.keep_one(no_documents(spark)).count() == 0


def brute_similar(texts, k, similarity):
    """Smallest reachable id over all pairs of shingle sets."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").lower().split()
        sets[i] = {tuple(words[n : n + k]) for n in range(len(words) - k + 1)} or {tuple(words)}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared >= similarity * (len(sets[a]) + len(sets[b]) - shared) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def copies(rng):
    """Texts with exact copies, near copies on both sides of the threshold, and one large group around a text."""
    texts = [prose(rng, rng.randrange(60, 300)) for _ in range(60)]
    for t in texts[:50]:
        for changes in (1, 2, 3, 6):
            words = t.split()
            for _ in range(changes):
                words[rng.randrange(len(words))] = f"other{rng.randrange(1000)}"
            texts.append(" ".join(words))
        texts.append(t.title())
    for _ in range(150):
        words = texts[55].split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = f"odd{rng.randrange(10000)}"
        texts.append(" ".join(words))
    return dict(enumerate(texts))


def test_similar_texts_are_found_and_others_stay(spark):
    texts = copies(random.Random(12))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    want = brute_similar(texts, 5, 0.8)
    gone, wanted = {i for i, r in found.items() if r != i}, {i for i, r in want.items() if r != i}
    assert all(want[r] == want[i] for i, r in found.items())  # no link that isn't there
    assert len(gone & wanted) > 0.95 * len(wanted) > 200
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {i for i, r in found.items() if r == i}


def test_the_same_groups_with_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SHORT", 5)
    texts = copies(random.Random(13))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    want = brute_similar(texts, 5, 0.8)
    assert all(want[r] == want[i] for i, r in found.items())
    assert sum(r != i for i, r in found.items()) > 0.93 * sum(r != i for i, r in want.items())


def test_word_blocks_split_long_texts_at_white_space(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    text = b"alder birch cedar drift\tember\x0bfjord grove"
    assert [w for block in simhash.word_blocks(text) for w in block] == text.split()
    assert simhash.fingerprint(text, 4) % (1 << 64) == brute_fingerprint(text.decode(), 4)


def test_no_pair_just_above_the_similarity_is_missed(spark):
    rng = random.Random(14)
    texts = []
    for _ in range(150):
        words = prose(rng, 304).split()
        other = words[:]
        for at in rng.sample(range(10, 290, 6), 6):  # 300 shingles, 30 of them other ones: 270 of 330 shared
            other[at] = f"other{rng.randrange(10**6)}"
        texts += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    want = brute_similar(dict(enumerate(texts)), 5, 0.8)
    assert found == want and sum(r != i for i, r in want.items()) == 150


def test_long_lists_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "levels", lambda texts, k: np.ones(simhash.SLOTS, np.uint8))  # no shingle is known as rare: all variants share lists
    rng = random.Random(15)
    texts, form = [], prose(rng, 104).split()
    for _ in range(60):
        words = form[:]
        for at in rng.sample(range(6, 98, 8), 3):
            words[at] = f"variant{rng.randrange(10**6)}"
        other = words[:]
        other[1] = f"copy{rng.randrange(10**6)}"
        texts += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert found == brute_similar(dict(enumerate(texts)), 5, 0.8)
