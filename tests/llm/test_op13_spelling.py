import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.corpus import CLASH, SCHEMA, no_documents, odd_documents
from vitrine.llm import queries, spelling


def words_of(rows, noise, shortest=7, least=2):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if noise and h % noise == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            if len(w) >= shortest:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= least}


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    a, b = sorted((u, v), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, ratio=10):
    out, form = {}, {}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w, k in n.items():
        others = [v for d in (-1, 0, 1) for v in by_length.get(len(w) + d, ()) if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * k else None
        out[w] = (k, len(others))
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), k, m, n[form[w]] if form[w] else None) for w, (k, m) in out.items())


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_chains_ties_and_kinds_of_difference(spark):
    n = {"abcdefg": 1000, "abcdefgh": 100, "abcdefghi": 10, "abcdefghij": 1, "xbcdefg": 100, "bcdefgh": 9, "aaaaaaa": 50, "aaaaaaaa": 5, "aaaaaaaaa": 2, "çéàèùâê": 40, "çéàèùâe": 3, "çéàèùâë": 40, "abcdegf": 7, "mmmmmmmn": 20, "mmmmmmmo": 20, "mmmmmmm": 2}
    docs = spark.createDataFrame([(i, " ".join(w for w, k in n.items() for _ in range(k // 2 if i else k - k // 2)), "en", "s", 0) for i in (0, 1)], SCHEMA)
    got = found(spelling.variants(docs, least=1))
    assert got == brute(n)
    chain = {r[0]: r for r in got}
    assert chain["abcdefghij"][2] == "abcdefg" and chain["mmmmmmm"][1] == "mmmmmmmn"


def test_random_words_against_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(60)]
    rows = [(rng.randrange(50), " ".join(rng.choice(base[: rng.randrange(1, 60)]).upper() if rng.random() < 0.2 else rng.choice(base) for _ in range(120))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = found(spelling.variants(docs, noise=31))
    assert got == brute(words_of(rows, 31)) and sum(r[1] is not None for r in got) > 3


def test_long_words(spark):
    rng = random.Random(2)
    w = "".join(rng.choice("abcdef") for _ in range(60_000))
    texts = [w, w, w[:30_000] + w[30_001:], w[:5] + "z" + w[6:], "a" * 50_000, "a" * 49_999]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts * 2)], SCHEMA)
    got = {len(r[0]): r[4] for r in found(spelling.variants(docs)) if r[0][:5] != w[:5] or r[0][5] != "z"}
    assert got == {60_000: 2, 59_999: 1, 50_000: 1, 49_999: 1}


def test_odd_rows_and_empty_table(spark):
    rows = spelling.variants(odd_documents(spark))
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(rows) == [("Ünïcödé", None, "Ünïcödé", 3, 0, None)]  # only A-Z change case
    assert spelling.variants(no_documents(spark).withColumns({c: F.lit(1) for c in CLASH})).count() == 0
    docs = spark.createDataFrame([(None, "Letters LETTERS", "en", "s", 0), (1, "lettters", "en", "s", 0), (1, "lettters", "en", "s", 0)], SCHEMA)
    assert found(spelling.variants(docs)) == [("letters", None, "letters", 2, 1, None), ("lettters", None, "lettters", 2, 1, None)]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.queries()["op13_spelling"](spark, sf_dir)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert found(got) == brute(words_of(docs, 31))
