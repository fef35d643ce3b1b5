import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import no_documents, odd_documents
from vitrine.llm import langid
from vitrine.llm.queries import op5_langid


def brute_grams(text):
    """n-grams of one to three characters of words marked at both ends."""
    words = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    if not words:
        return Counter()
    marked = f" {words} "
    out = Counter(c for c in marked if c != " ")
    out.update(marked[i : i + 2] for i in range(len(marked) - 1))
    out.update(x for i in range(len(marked) - 2) if (x := marked[i : i + 3])[1] != " ")
    return out


def ranked(counts, n):
    return [g for g, _ in sorted(counts.items(), key=lambda p: (-p[1], (len(p[0]), p[0])))[:n]]


def brute_predict(text, profiles):
    doc = ranked(brute_grams(text), langid.RANKS)
    if not doc:
        return "und", 0.0
    best = min((sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(doc)), name) for name, p in sorted(profiles.items()))
    return best[1], 1 - best[0] / (langid.PROFILE * len(doc))


TEXTS = [("the cat and the dog went there", "en"), ("der hund und die katze gehen dorthin", "de"), ("le chat et le chien sont partis", "fr"), ("el perro y el gato se fueron", "es")]


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(t.split()) for _ in range(rng.randrange(1, 40))), lang) for i, (t, lang) in enumerate(TEXTS * 12)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "unlabelled words", None)], "doc_id long, text string, lang string")
    counts = {}
    for _, t, lang in rows:
        counts.setdefault(lang, Counter()).update(brute_grams(t))
    profiles = {lang: ranked(c, langid.PROFILE) for lang, c in counts.items()}
    fitted = langid.fit(docs)
    decoded = {lang: ["".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s) for g in p] for lang, p in fitted.items()}
    assert {k: set(v) for k, v in decoded.items()} == {k: set(v) for k, v in profiles.items()}
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, fitted).collect()}
    for i, t, _ in [*rows, (900, None, None), (901, "unlabelled words", None)]:
        lang, score = brute_predict(t, decoded)
        assert found[i] == (lang, pytest.approx(score))


def test_held_out_accuracy(spark, sf_dir):
    found = op5_langid(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(truth.where("lang is not null"), "doc_id")
    n, right = held.count(), held.where("lang = lang_pred").count()
    assert n > 20 and right / n > 0.97
    assert found.count() == truth.count()
    assert found.where("score < 0 or score > 1 or score is null or lang_pred is null").count() == 0


def test_prediction_uses_the_text_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = langid.fit(docs)
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, profiles).collect()}
    other = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("y").alias("source"))
    b = {r["doc_id"] - 1: (r["lang_pred"], r["score"]) for r in langid.predict(other, profiles).collect()}
    assert a == b


def test_a_bounded_sample_fits_as_well(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.predict(docs, langid.fit(docs, sample=60)).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert found.where("lang = lang_pred").count() > 0.93 * found.count()


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    profiles = langid.fit(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(TEXTS)], "doc_id long, text string, lang string"))
    rows = langid.predict(docs, profiles).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert langid.fit(no_documents(spark)) == {}
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.predict(no_documents(spark), profiles).count() == 0
    kept = langid.keep_known(docs, profiles)
    assert kept.columns == docs.columns and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("text", ["²³½", "12 ٣٤ ¼", "— 🙂 …", "漢字", "a²b"])
def test_numbers_are_no_letters(text):
    grams, _ = langid.codes(text)
    assert bool(len(grams)) == any(c.isalpha() for c in text)
    assert all(chr(int(g) >> s & 0x1FFFFF).isalpha() for g in grams for s in (0, 21, 42) if int(g) >> s & 0x1FFFFF not in (0, 32))


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"wörd{'x' * (i % 7)} {i}" for i in range(3000))
    whole = langid.codes(text)
    monkeypatch.setattr(langid, "BLOCK", 100)
    cut = langid.codes(text)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
